"""Frames as one binary each: block kernels over Arrow batches, so that a frame is one row wherever it goes.

A frame of width x height pixels (both even) is a binary of three bytes a pixel, row by row. Kernels take a stack of
frames as an array (n, height, width, 3). A frame that is null, or whose length isn't the size's, can't be used: it has
no blocks and an error elsewhere. Only sampled pixels of a frame are shuffled to find scene cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered, segments
from .ordered import Stream

#: Sampled pixels of a frame that tell a scene cut, and the mean change above which there is one.
SCENE_PIXELS, SCENE_CHANGE = 4_096, 40
#: Frames of a block of a running value.
FRAMES_A_BLOCK = 4_096


def stacked(column: pa.Array, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """The frames that have the right size, as one array, and their places in the column."""
    size = width * height * 3
    data = [x.as_py() for x in column]
    at = np.array([i for i, x in enumerate(data) if x is not None and len(x) == size], np.int64)
    return np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), height, width, 3), at


def block_matrix(frames: np.ndarray) -> np.ndarray:
    """(n, blocks, 12): the colours of each 2x2 block, row by row."""
    n, height, width, _ = frames.shape
    return frames.reshape(n, height // 2, 2, width // 2, 2, 3).transpose(0, 1, 3, 2, 4, 5).reshape(n, height * width // 4, 12)


def unblocked(blocks: np.ndarray, width: int, height: int) -> np.ndarray:
    """The inverse of block_matrix, for blocks of four pixels of any depth."""
    n = len(blocks)
    return blocks.reshape(n, height // 2, width // 2, 2, 2, -1).transpose(0, 1, 3, 2, 4, 5).reshape(n, height, width, -1)


def halved(frames: np.ndarray) -> np.ndarray:
    """Frames of half the width and height: the rounded means of each 2x2 block."""
    n, height, width, _ = frames.shape
    sums = block_matrix(frames).reshape(n, height // 2, width // 2, 4, 3).sum(3, dtype=np.int64)
    return ((sums + 2) // 4).astype(np.uint8)


def from_pixels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rgb) of a row a pixel (keys, x, y, r, g, b), none missing; pixels are combined once, by frame."""
    four = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    digits = F.transform(four, lambda p: F.concat(*[F.lpad(F.hex(p[c].cast("long")), 2, "0") for c in "rgb"]))
    return pixels.groupBy(*keys).agg(F.unhex(F.array_join(digits, "")).alias("rgb"))


def block_rows(frames: DataFrame, keys: list[str], width: int, height: int, rgb: str = "rgb") -> DataFrame:
    """(keys, block_x, block_y, v array<double>): a row for each block, without a shuffle."""
    each, across = width * height // 4, width // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 64):
                b = batch.slice(row, 64)
                stack, at = stacked(b[rgb], width, height)
                v = block_matrix(stack).astype(np.float64).ravel()
                whose = pa.array(np.repeat(at, each))
                place = np.tile(np.arange(each), len(at))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, 12), pa.int32()), pa.array(v))
                yield pa.record_batch([*[b[k].take(whose) for k in keys], pa.array(place % across), pa.array(place // across), values], [*keys, "block_x", "block_y", "v"])

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, rgb).mapInArrow(work, f"{kinds}, block_x long, block_y long, v array<double>")


def grouped(frames: DataFrame, clip: str, frame: str, width: int, height: int, longest: int, rgb: str = "rgb", most: int = SCENE_PIXELS, limit: int = SCENE_CHANGE) -> DataFrame:
    """(clip, frame, cut, group, place): groups of frames, which begin at scene cuts and after `longest` frames.

    A frame is a cut where the mean change of its samples against the frame before, as a whole number, is above `limit`.
    Every (width * height / most)-th pixel is a sample; these are all of a frame that is shuffled."""
    step = max(1, width * height // most)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stack, at = stacked(b[rgb], width, height)
            seen = stack.reshape(len(at), width * height, 3)[:, ::step]
            data: list[bytes | None] = [None] * len(b)
            for i, s in zip(at.tolist(), seen, strict=True):
                data[i] = s.tobytes()
            yield pa.record_batch([b[clip], b[frame], pa.array(data, pa.binary())], [clip, frame, "seen"])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [(x, y) for x, y in zip(b["seen"].to_pylist(), b["before"].to_pylist(), strict=True)]
            cut = [x is not None and y is not None and int(np.abs(np.frombuffer(x, np.uint8).astype(np.int64) - np.frombuffer(y, np.uint8)).sum()) // max(1, len(x)) > limit for x, y in both]
            yield pa.record_batch([b[clip], b[frame], pa.array(cut, pa.bool_())], [clip, frame, "cut"])

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in (clip, frame))
    stream = Stream([clip], [frame], F.floor(F.col(frame) / FRAMES_A_BLOCK))
    seen = frames.select(clip, frame, rgb).mapInArrow(sample, f"{kinds}, seen binary")
    cuts = ordered.previous(seen, stream, "before", F.col("seen")).mapInArrow(change, f"{kinds}, cut boolean")
    return segments.segmented(cuts, stream, F.col("cut"), longest).select(clip, frame, "cut", F.col("segment").alias("group"), "place")


def viewed(frames: DataFrame, keys: list[str], width: int, height: int, out_width: int, out_height: int, scale: int, x: int = 0, y: int = 0, rgb: str = "rgb") -> DataFrame:
    """(keys, rgb): each frame seen through an affine view: the pixel at (i, j) shows the frame's ((x + scale * i) >> 8, (y + scale * j) >> 8), black outside it.

    Indices are computed once; a frame is gathered inside its row, so no pixel is joined."""
    across, down = (x + scale * np.arange(out_width)) >> 8, (y + scale * np.arange(out_height)) >> 8
    inside = ((down >= 0) & (down < height))[:, None] & ((across >= 0) & (across < width))[None, :]
    rows, columns = np.clip(down, 0, height - 1), np.clip(across, 0, width - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stack, at = stacked(b[rgb], width, height)
            shown: list[bytes | None] = [None] * len(b)
            for i, f in zip(at.tolist(), stack, strict=True):
                shown[i] = np.where(inside[:, :, None], f[rows[:, None], columns[None, :]], np.uint8(0)).tobytes()
            yield pa.record_batch([*[b[k] for k in keys], pa.array(shown, pa.binary())], [*keys, "rgb"])

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, rgb).mapInArrow(work, f"{kinds}, rgb binary")


def compared(frames: DataFrame, keys: list[str], rgb: str, other: str) -> DataFrame:
    """(keys, mse): the mean squared difference of two binaries of a row; null where one is null or their lengths differ."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[float | None] = []
            for x, y in zip(b[rgb].to_pylist(), b[other].to_pylist(), strict=True):
                usable = x is not None and y is not None and len(x) == len(y) > 0
                found.append(float(((np.frombuffer(x, np.uint8).astype(np.int64) - np.frombuffer(y, np.uint8)) ** 2).sum()) / len(x) if usable else None)
            yield pa.record_batch([*[b[k] for k in keys], pa.array(found, pa.float64())], [*keys, "mse"])

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*keys, rgb, other).mapInArrow(work, f"{kinds}, mse double")
