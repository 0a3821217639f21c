"""Groups of packed frames as records of bytes, each group with its own palette and each frame with its own codebook.

A group (see packed.grouped) is bounded by its length, is one row a frame in one shuffle, and is encoded and decoded
without any other: its first two frames, one on either of two alternating pages, send every block; a later frame sends a
block only where it differs by more than `skip` (squared) from what its page got last. A palette of COLOURS entries,
black first, is fitted to sampled pixels of the group. What a frame sends is quantised with a codebook of blocks of four
palette entries fitted to the blocks it sends. A record is, little-endian:

    1 byte    1 in a frame that sends every block, plus 2 in a group's first
    1 byte    zero
    2 bytes   entries of the codebook
    512 bytes the palette, 15-bit colours (a group's first record only)
    4 bytes   each entry: palette entries of the block's pixels, row by row
    ops       below 128: that many blocks and one more stay; from 128 on: 127 less blocks follow as codebook entries
    padding   zeros to a multiple of four bytes

Clusters are fitted in doubles with sums of whole numbers, so results don't depend on the order of rows. A frame of the
wrong size makes its group's records null with an error; a corrupt record ends its group's frames with one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed
from .cluster import fitted, nearest_of

# Palette entries, rounds that fit palette and codebook, sampled pixels of a group, sampled blocks of a frame, longest op.
COLOURS, PALETTE_ROUNDS, CODEBOOK_ROUNDS, PALETTE_PIXELS, CODEBOOK_BLOCKS, RUN_MOST = 256, 8, 4, 50_000, 4_096, 128
PAGES = 2


def colour_word(rgb: np.ndarray) -> np.ndarray:
    """15-bit colours of (..., 3) bytes, red lowest."""
    five = rgb.astype(np.int64) >> 3
    return five[..., 0] | five[..., 1] << 5 | five[..., 2] << 10


def colour_bytes(word: np.ndarray) -> np.ndarray:
    """(..., 3) bytes of 15-bit colours: five bits, their high three repeated below."""
    five = np.stack([word >> s & 31 for s in (0, 5, 10)], axis=-1)
    return (five << 3 | five >> 2).astype(np.uint8)


def whole_bytes(x: np.ndarray) -> np.ndarray:
    """Rounded to the nearest byte, halves up."""
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def palette_of(pixels: np.ndarray, colours: int = COLOURS) -> np.ndarray:
    """The 15-bit palette of (n, 3) pixels: black, then the centres of clusters, zeros behind them."""
    words = np.zeros(colours, np.int64)
    centres = fitted(pixels.astype(np.float64), colours - 1, PALETTE_ROUNDS)
    words[1 : 1 + len(centres)] = colour_word(whole_bytes(centres))
    return words


class Slots:
    """Which palette entry shows a colour: the nearest one to its 15-bit form; of equally near ones the first."""

    def __init__(self, words: np.ndarray) -> None:
        self.rgb = colour_bytes(words).astype(np.float64)
        self.of = np.full(1 << 15, -1, np.int64)

    def __call__(self, rgb: np.ndarray) -> np.ndarray:
        word = colour_word(rgb)
        new = np.unique(word[self.of[word] < 0])
        self.of[new] = nearest_of(colour_bytes(new).astype(np.float64), self.rgb)
        return self.of[word]


def op_stream(codes: np.ndarray) -> bytes:
    """Ops of a frame's codes, -1 where a block stays; an op holds RUN_MOST blocks at most."""
    n = len(codes)
    sent = codes >= 0
    change = np.flatnonzero(np.diff(sent, prepend=~sent[:1]))
    since = np.arange(n) - np.repeat(change, np.diff(np.append(change, n)))
    start = np.flatnonzero(since % RUN_MOST == 0)
    length = np.diff(np.append(start, n))
    head = np.arange(len(start)) + (np.cumsum(sent) - sent)[start]  # an op's place: the ops and the codes before it
    out = np.zeros(len(start) + int(sent.sum()), np.uint8)
    out[head] = np.where(sent[start], 127 + length, length - 1)
    rest = np.ones(len(out), bool)
    rest[head] = False
    out[rest] = codes[sent]
    return out.tobytes()


def expanded(ops: bytes, blocks: int, entries: int) -> tuple[np.ndarray, int]:
    """The codes of a frame's ops, and how many bytes they took; the inverse of op_stream."""
    codes, at, block = np.full(blocks, -1, np.int64), 0, 0
    while block < blocks:
        if at >= len(ops):
            raise ValueError("ops end before the frame does")
        n = ops[at] - 127 if ops[at] > 127 else ops[at] + 1
        if block + n > blocks:
            raise ValueError("ops go beyond the frame")
        if ops[at] > 127:
            got = np.frombuffer(ops[at + 1 : at + 1 + n], np.uint8)
            if len(got) < n:
                raise ValueError("ops end before the frame does")
            if int(got.max()) >= entries:
                raise ValueError("an op names an entry that the codebook hasn't")
            codes[block : block + n] = got
            at += n
        at, block = at + 1, block + n
    return codes, at


def record(first: bool, whole: bool, palette: np.ndarray, book: np.ndarray, codes: np.ndarray) -> bytes:
    head = bytes([whole + 2 * first, 0]) + len(book).to_bytes(2, "little")
    body = head + (palette.astype("<u2").tobytes() if first else b"") + book.astype(np.uint8).tobytes() + op_stream(codes)
    return body + bytes(-len(body) % 4)


def parsed(data: bytes | None, blocks: int, colours: int = COLOURS) -> tuple[bool, bool, np.ndarray | None, np.ndarray, np.ndarray]:
    """first, whole, palette (or None), codebook and codes of a record; a ValueError says what is wrong with a corrupt one."""
    if data is None or len(data) < 4 or len(data) % 4 or data[0] > 3 or data[1]:
        raise ValueError("no record")
    first, whole, n = bool(data[0] & 2), bool(data[0] & 1), int.from_bytes(data[2:4], "little")
    start = 4 + 2 * colours * first
    if start + 4 * n > len(data):
        raise ValueError("the codebook goes beyond the record")
    palette = np.frombuffer(data[4:start], "<u2").astype(np.int64) if first else None
    codes, used = expanded(data[start + 4 * n :], blocks, n)
    tail = data[start + 4 * n + used :]
    if len(tail) > 3 or any(tail):
        raise ValueError("bytes remain behind the ops")
    return first, whole, palette, np.frombuffer(data[start : start + 4 * n], np.uint8).reshape(n, 4), codes


def group_records(frames: np.ndarray, codebook: int, skip: float, colours: int = COLOURS) -> list[bytes]:
    """The records of a group's frames (n, height, width, 3), in order."""
    blocks = packed.block_matrix(frames).astype(np.float64)
    pixels = frames.reshape(-1, 3)
    palette = palette_of(pixels[:: max(1, len(pixels) // PALETTE_PIXELS)], colours)
    slots, shown, out = Slots(palette), [blocks[0].copy() for _ in range(PAGES)], []
    for i, now in enumerate(blocks):
        page = shown[i % PAGES]
        apart = sum(((now[:, d] - page[:, d]) ** 2 for d in range(12)), np.zeros(len(now)))
        sent = np.flatnonzero((apart > skip) | (i < PAGES))
        sample = now[sent][:: max(1, len(sent) // CODEBOOK_BLOCKS)]
        centres = whole_bytes(fitted(sample, codebook, CODEBOOK_ROUNDS)).reshape(-1, 4, 3)
        book = np.unique(slots(centres), axis=0) if len(centres) else np.zeros((0, 4), np.int64)
        codes = np.full(len(now), -1, np.int64)
        codes[sent] = nearest_of(now[sent], slots.rgb[book].reshape(len(book), 12))
        page[sent] = now[sent]
        out.append(record(i == 0, i < PAGES, palette, book, codes))
    return out


def encoded(frames: DataFrame, clip: str, group: str, place: str, width: int, height: int, codebook: int, skip: float, rgb: str = "rgb", carry: list[str] | None = None, colours: int = COLOURS) -> DataFrame:
    """(clip, group, place, carried columns, record, error) of frames in groups, by one shuffle of a row a frame."""
    keep = [clip, group, place, *(carry or [])]

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(place).combine_chunks()
        stack, at = packed.stacked(rows[rgb].combine_chunks() if isinstance(rows[rgb], pa.ChunkedArray) else rows[rgb], width, height)
        whole = len(at) == len(rows)
        records = group_records(stack, codebook, skip, colours) if whole else [None] * len(rows)
        error = pa.array([None if whole else "a frame of the group hasn't the right size"] * len(rows), pa.string())
        return pa.table([*[rows[k] for k in keep], pa.array(records, pa.binary()), error], [*keep, "record", "error"])

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keep)
    return frames.select(*keep, rgb).groupBy(clip, group).applyInArrow(work, f"{kinds}, record binary, error string")


def decoded(records: DataFrame, clip: str, group: str, place: str, width: int, height: int, data: str = "record", carry: list[str] | None = None, colours: int = COLOURS) -> DataFrame:
    """(clip, group, place, carried columns, rgb, error): the frames that a group's records show; from a corrupt record on they are null."""
    keep, blocks = [clip, group, place, *(carry or [])], width * height // 4

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(place)
        pages, palette, wrong, shown, errors = [np.zeros((blocks, 4), np.int64) for _ in range(PAGES)], np.zeros(colours, np.int64), None, [], []
        for i, x in enumerate(rows[data].to_pylist()):
            try:
                if wrong is None:
                    first, _, own, book, codes = parsed(x, blocks, colours)
                    if first != (i == 0):
                        raise ValueError("a group's first record isn't where it should be")  # noqa: TRY301
                    palette = own if own is not None else palette
                    if len(book) and int(book.max()) >= colours:
                        raise ValueError("the codebook names a colour that the palette hasn't")  # noqa: TRY301
                    pages[i % PAGES][codes >= 0] = book[codes[codes >= 0]]
            except ValueError as e:
                wrong = str(e)
            shown.append(None if wrong else packed.unblocked(colour_bytes(palette)[pages[i % PAGES]][None], width, height).tobytes())
            errors.append(wrong)
        return pa.table([*[rows[k] for k in keep], pa.array(shown, pa.binary()), pa.array(errors, pa.string())], [*keep, "rgb", "error"])

    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keep)
    return records.select(*keep, data).groupBy(clip, group).applyInArrow(work, f"{kinds}, rgb binary, error string")


def op_rows(records: DataFrame, keys: list[str], blocks: int, data: str = "record", colours: int = COLOURS) -> DataFrame:
    """(keys, block, code, error): a row for each block that a record sends; one row with the error of a corrupt record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whose, block, code, error = [], [], [], []
            for i, x in enumerate(b[data].to_pylist()):
                try:
                    codes = parsed(x, blocks, colours)[4]
                    sent = np.flatnonzero(codes >= 0)
                    found = (sent.tolist(), codes[sent].tolist(), [None] * len(sent))
                except ValueError as e:
                    found = ([None], [None], [str(e)])
                whose += [i] * len(found[0])
                block, code, error = block + found[0], code + found[1], error + found[2]
            at = pa.array(whose, pa.int64())
            yield pa.record_batch([*[b[k].take(at) for k in keys], pa.array(block, pa.int64()), pa.array(code, pa.int64()), pa.array(error, pa.string())], [*keys, "block", "code", "error"])

    kinds = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys)
    return records.select(*keys, data).mapInArrow(work, f"{kinds}, block long, code long, error string")
