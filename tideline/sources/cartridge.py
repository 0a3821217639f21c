"""Cartridges: binary files of several videos with offset tables, as a data source that reads sections and commits whole files.

A cartridge has a header of 160 bytes, the sections of each video (cues, audio, frames) and a table of videos of 64 bytes
each, all little-endian and aligned to four bytes. A frame section is a table of 32-bit offsets and then the records.

    spark.dataSource.register(Cartridges)
    spark.read.format("cartridges").option("section", "frames").load(folder)
    built.write.format("cartridges").mode("append").save(folder)      # rows (name, image)

A section's reader reads headers and tables on the driver, 160 + 64 n bytes a file, and partitions by ranges of the offset
table; a task seeks to its range and reads no other section. `marker` (hex of 8 bytes) finds the cartridge inside a
program image: behind it stands its place, counted from `origin`. The folder must be a mounted one, as reading is by
seeking; whole files in any store can come through binaryFile and `sections_of`.

A writer's task writes files to a folder of its job; the commit moves them into place one by one, an abort removes them.
A file replaces the one of its name, so a replayed job or micro-batch gives the same folder.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from tideline.functions.media import RATE, SCREEN_H, SCREEN_W

# Bytes of the header, a video's entry, a cue's entry, the cues' palette, a sprite; version; bytes of an audio block; largest cartridge.
HEADER, ENTRY, CUE, CUE_PALETTE, SPRITE, VERSION, AUDIO_BLOCK, LARGEST = 160, 64, 16, 32, 260, 4, 1028, 32 << 20
#: What a file begins with, unless the option `magic` (hex of 8 bytes) says otherwise; frames or audio blocks of a partition.
MAGIC, RANGE = b"TIDELINE", 4_096
SCHEMAS = {
    "videos": "path string, video int, title string, n_frames long, fps int, w int, h int, x_off int, y_off int, half_res boolean, audio_samples long, total_samples long, n_cues long, fill int, fill_x int, fill_y int",
    "frames": "path string, video int, frame long, record binary",
    "audio": "path string, video int, block long, data binary",
    "cues": "path string, video int, cue long, start_sample long, end_sample long, w int, h int, sprites array<struct<x:int,y:int,tiles:binary>>",
}


class View:
    """Ranged reads of a cartridge: of an open file or of bytes, from a base on."""

    def __init__(self, file, size: int, base: int = 0) -> None:  # noqa: ANN001
        self.file, self.size, self.base = file, size - base, base

    def at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise ValueError("offsets out of range")
        self.file.seek(self.base + offset)
        return self.file.read(n)

    def words(self, offset: int, n: int) -> np.ndarray:
        return np.frombuffer(self.at(offset, 4 * n), "<u4").astype(np.int64)


def opened(file, size: int, marker: bytes | None, origin: int) -> View:  # noqa: ANN001
    """The cartridge of a file, or the one that a program image points to behind a marker."""
    if not marker:
        return View(file, size)
    file.seek(0)
    tail, at = b"", 0
    while chunk := file.read(1 << 20):
        found = (tail + chunk).find(marker)
        if found >= 0:
            place = View(file, size).words(at - len(tail) + found + 8, 1)[0] - origin
            if not 0 <= place < size:
                raise ValueError("the image points to no cartridge")
            return View(file, size, int(place))
        tail, at = (tail + chunk)[-(len(marker) - 1) :], at + len(chunk)
    raise ValueError("the image has no marker")


def contents(view: View, magic: bytes = MAGIC) -> list[dict]:
    """The videos of a cartridge, with the places of their sections."""
    if view.size < HEADER:
        raise ValueError("not a cartridge")
    head = view.at(0, HEADER)
    if head[:8] != magic:
        raise ValueError("not a cartridge")
    if (version := struct.unpack_from("<I", head, 8)[0]) != VERSION:
        raise ValueError(f"unsupported version {version}")
    title = head[60:92].split(b"\0")[0].decode("latin-1")
    count, table = struct.unpack_from("<2I", head, 148)
    if count * ENTRY > view.size:
        raise ValueError("offsets out of range")
    out = []
    for i, e in enumerate(struct.iter_unpack("<6I4HIH2x2i4I", view.at(table, count * ENTRY))):
        frames, frames_at, audio_at, samples, _, total, w, h, x, y, half, fill, fill_x, fill_y, cues, cues_at, fps, _ = e
        if audio_at > frames_at or frames_at + 4 * frames > view.size or cues_at + CUE_PALETTE * (cues > 0) + CUE * cues > view.size:
            raise ValueError("offsets out of range")
        out.append({"video": i, "title": title, "n_frames": frames, "frames_at": frames_at, "audio_at": audio_at, "audio_samples": samples, "total_samples": total, "w": w, "h": h, "x_off": x, "y_off": y, "half_res": bool(half & 1), "fill": fill, "fill_x": fill_x, "fill_y": fill_y, "n_cues": cues, "cues_at": cues_at, "fps": fps})
    bounds = sorted({view.size, table, *[v[k] for v in out for k in ("frames_at", "audio_at", "cues_at")]})
    for v in out:  # a section ends where another begins
        v["frames_end"] = next(b for b in bounds if b > v["frames_at"] or b == view.size)
    return out


def rows_of(view: View, v: dict, section: str, first: int, to: int) -> Iterator[tuple]:
    """Rows first .. to - 1 of a video's section, without its path."""
    if section == "videos":
        yield tuple(v[n.split()[0]] for n in SCHEMAS["videos"].split(", ")[1:])
    elif section == "frames":
        more = min(to + 1, v["n_frames"])
        begins = view.words(v["frames_at"] + 4 * first, more - first)
        ends = np.append(begins[1:], v["frames_end"]) if more == to else begins[1:]
        for i, (a, z) in enumerate(zip(begins.tolist(), ends.tolist(), strict=False)):
            yield v["video"], first + i, view.at(a, z - a)
    elif section == "audio":
        for i in range(first, to):
            at = v["audio_at"] + i * AUDIO_BLOCK
            yield v["video"], i, view.at(at, min(AUDIO_BLOCK, v["frames_at"] - at))
    else:
        for i in range(first, to):
            start, end, at, n, w, h = struct.unpack("<3I3Bx", view.at(v["cues_at"] + CUE_PALETTE + CUE * i, CUE))
            data = view.at(at, n * SPRITE)
            yield v["video"], i, start, end, w, h, [(data[k], data[k + 1], data[k + 4 : k + SPRITE]) for k in range(0, n * SPRITE, SPRITE)]


def _rows(v: dict, section: str) -> int:
    return {"videos": 1, "frames": v["n_frames"], "audio": -(-(v["frames_at"] - v["audio_at"]) // AUDIO_BLOCK), "cues": v["n_cues"]}[section]


@dataclass
class Range(InputPartition):
    """Rows of a section of one video of a file."""

    path: str
    video: int
    first: int
    to: int


class Reader(DataSourceReader):
    def __init__(self, path: str, section: str, magic: bytes, marker: bytes | None, origin: int) -> None:
        self.path, self.section, self.magic, self.marker, self.origin = path, section, magic, marker, origin

    def _view(self, path: str, file) -> View:  # noqa: ANN001
        return opened(file, os.path.getsize(path), self.marker, self.origin)

    def partitions(self) -> list[InputPartition]:
        paths = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n[0] not in "._") if os.path.isdir(self.path) else [self.path]
        out: list[InputPartition] = []
        for p in paths:
            with open(p, "rb") as f:
                for v in contents(self._view(p, f), self.magic):
                    n = _rows(v, self.section)
                    out += [Range(p, v["video"], a, min(a + RANGE, n)) for a in range(0, n, RANGE)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            view = self._view(partition.path, f)
            v = contents(view, self.magic)[partition.video]
            for row in rows_of(view, v, self.section, partition.first, partition.to):
                yield (partition.path, *row)


@dataclass
class Written(WriterCommitMessage):
    """Where a task's drafts are; the process that commits needn't be the one that planned the write."""

    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    """Whole files: tasks write them to the job's own folder, the commit moves them into place."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.pending = path, overwrite, os.path.join(path, f".pending-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.pending, exist_ok=True)
        names = []
        for row in iterator:
            name, image = row["name"], row["image"]
            if not name or name != os.path.basename(name) or name[0] in "._":
                raise ValueError(f"no file name: {name!r}")
            if image is None or len(image) > LARGEST:
                raise ValueError(f"{name}: no image, or more than {LARGEST} bytes")
            draft = os.path.join(self.pending, f"{name}.{uuid.uuid4().hex}")  # another attempt of the task may be writing too
            with open(draft, "wb") as f:
                f.write(image)
            names.append(os.path.basename(draft))
        return Written(self.pending, names)

    def commit(self, messages: list[Written | None]) -> None:
        drafts = [(m.folder, n, n.rpartition(".")[0]) for m in messages if m for n in m.names]
        if self.overwrite and os.path.isdir(self.path):
            for old in set(os.listdir(self.path)) - {final for _, _, final in drafts}:
                if old[0] not in "._":
                    os.remove(os.path.join(self.path, old))
        for folder, draft, final in drafts:
            os.replace(os.path.join(folder, draft), os.path.join(self.path, final))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        for folder in {self.pending, *[m.folder for m in messages if m]}:
            shutil.rmtree(folder, ignore_errors=True)


class StreamWriter(DataSourceStreamWriter):
    """The same for each micro-batch; a batch that is replayed writes the same files over those it has written."""

    def __init__(self, path: str) -> None:
        self.files = Writer(path, False)

    def write(self, iterator: Iterator) -> Written:
        return self.files.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        os.makedirs(self.files.path, exist_ok=True)
        self.files.commit(messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.files.abort(messages)


class Cartridges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cartridges"

    def schema(self) -> str:
        section = self.options.get("section", "videos")
        if section not in SCHEMAS:
            raise ValueError(f"section is one of {', '.join(SCHEMAS)}, not {section!r}")
        return SCHEMAS[section]

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema) -> Reader:  # noqa: ANN001
        get = self.options.get
        return Reader(self._path(), get("section", "videos"), bytes.fromhex(get("magic", MAGIC.hex())), bytes.fromhex(get("marker", "")) or None, int(get("origin", "0")))

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(self._path(), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:  # noqa: ANN001, N802
        return StreamWriter(self._path())


def aligned(data: bytes) -> bytes:
    return data + bytes(-len(data) % 4)


def image_of(title: str, videos: list[dict], magic: bytes = MAGIC) -> bytes:
    """A cartridge of videos: dicts with fps, w, h, x_off, y_off, half_res, audio_samples, and the lists frames, audio and cues (start, end, w, h, sprites)."""
    out, table = bytearray(HEADER), b""
    heads = []
    for v in videos:
        cues_at = len(out)
        if v["cues"]:
            out += bytes(CUE_PALETTE)
            data_at, entries = len(out) + CUE * len(v["cues"]), b""
            data = b""
            for start, end, w, h, sprites in v["cues"]:
                entries += struct.pack("<3I3Bx", start, end, data_at + len(data), len(sprites), w, h)
                data += b"".join(bytes([x, y, 0, 0]) + bytes(tiles) for x, y, tiles in sprites)
            out += entries + data
        audio_at = len(out)
        out += aligned(b"".join(v["audio"]))
        frames_at, n = len(out), len(v["frames"])
        sizes = np.array([-(-len(f) // 4) * 4 for f in v["frames"]], np.int64)
        out += (frames_at + 4 * n + np.cumsum(sizes) - sizes).astype("<u4").tobytes() + b"".join(map(aligned, v["frames"]))
        step = (RATE << 16) // v["fps"]
        scale = int(256 * min(v["w"] / SCREEN_W, v["h"] / SCREEN_H))
        fill = (scale, (2 * v["x_off"] + v["w"]) * 128 - SCREEN_W // 2 * scale, (2 * v["y_off"] + v["h"]) * 128 - SCREEN_H // 2 * scale)
        size = (v["w"], v["h"], v["x_off"], v["y_off"])
        table += struct.pack("<6I4HIH2x2i4I", n, frames_at, audio_at, v["audio_samples"], step, n * step >> 16, *size, v["half_res"], *fill, len(v["cues"]), cues_at, v["fps"], 0)
        heads.append((v["fps"], n, size, v["half_res"], v["audio_samples"], audio_at, frames_at, step, n * step >> 16, len(v["cues"]), cues_at, fill))
    table_at = len(out)
    out += table
    if heads:
        fps, n, size, half, samples, audio_at, frames_at, step, total, cues, cues_at, fill = heads[0]
        out[8:60] = struct.pack("<5I4H6I", VERSION, half, fps, 1, n, *size, RATE, samples, audio_at, frames_at, step, 0)
        out[116:140] = struct.pack("<3IH2x2i", total, cues, cues_at, *fill)
    else:
        out[8:12] = struct.pack("<I", VERSION)
    out[:8] = magic
    out[60:91] = title.encode("ascii", "replace")[:31].ljust(31, b"\0")
    out[148:156] = struct.pack("<2I", len(videos), table_at)
    return bytes(out)


PART = "video int, kind string, no long, data binary, fps int, w int, h int, x_off int, y_off int, half_res boolean, samples long"


def assembled(parts: DataFrame, cart: str, title: str, limit: int = LARGEST) -> DataFrame:
    """(cart, image, error) of parts: rows (cart, title, and PART) of kind video, frame or audio.

    A cartridge's sizes are added up first; one above the limit has an error and its data are never gathered."""
    size = F.coalesce(F.octet_length("data"), F.lit(0)) + F.when(F.col("kind") == "frame", 4 + 3).when(F.col("kind") == "video", ENTRY).otherwise(3)
    sizes = parts.groupBy(cart).agg(F.sum(size).alias("_size"))
    fits = sizes.where(F.col("_size") + HEADER <= limit).select(cart)
    over = sizes.where(F.col("_size") + HEADER > limit).select(cart, F.lit(None).cast("binary").alias("image"), F.concat(F.lit("more than "), F.lit(limit), F.lit(" bytes")).alias("error"))
    names = [c.split()[0] for c in PART.split(", ")]

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        found = rows.sort_by([("video", "ascending"), ("no", "ascending")]).to_pylist()
        videos: dict[int, dict] = {}
        for r in (r for r in found if r["kind"] == "video"):
            videos[r["video"]] = {k: r[k] for k in ("fps", "w", "h", "x_off", "y_off", "half_res")} | {"audio_samples": r["samples"] or 0, "frames": [], "audio": [], "cues": []}
        error = None
        for r in (r for r in found if r["kind"] != "video"):
            if r["video"] not in videos or r["data"] is None:
                error = "a part without data or video"
                continue
            videos[r["video"]]["frames" if r["kind"] == "frame" else "audio"].append(r["data"])
        image = None if error else image_of(next((r["_title"] for r in found if r["_title"]), ""), list(videos.values()))
        return pa.table([pa.array([key[0].as_py()], key[0].type), pa.array([image], pa.binary()), pa.array([error], pa.string())], [cart, "image", "error"])

    kind = parts.schema[cart].dataType.simpleString()
    rows = parts.join(fits, cart).select(cart, F.col(title).alias("_title"), *names)
    return rows.groupBy(cart).applyInArrow(build, f"`{cart}` {kind}, image binary, error string").union(over)
