"""Media columns for telephony audio: G.711 mu-law and A-law, and IMA ADPCM blocks.

A payload is stored as a WAVE file of 8-bit mu-law codes and read back from the stored bytes. Codes expand by
lookup tables built from the G.711 rule; the same bytes seen as ADPCM blocks (a 4-byte header, then two samples a
byte) are decoded with numpy across all blocks of a batch, one column of nibbles at a time. The expanded samples are
also stored as a WAVE file of 16-bit PCM, resampled by an integer ratio with linear interpolation. Both files are read
back; what is returned comes from there. Everything is in integers, so equal payloads give equal values anywhere.

Null payloads count as empty. The query's payload is the text in UTF-8, padded with byte 32 to a positive multiple of
a block. Rows are independent (no shuffle); repeated rows repeat, an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, slices

#: Bytes of an ADPCM block, of which 4 are its header; samples a second.
BLOCK, RATE = 192, 8000
# Format tags of WAVE files.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
# Index changes of IMA ADPCM, by the low three bits of a code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# Step sizes of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
        143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
        1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
        9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """Sample of each mu-law code: inverted bits, a chord that doubles, a bias of 132."""
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Sample of each A-law code: even bits inverted, a straight first chord, then chords that double."""
    code = np.arange(256) ^ 0x55
    chord, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(chord == 0, step + 8, step + 0x108 << np.maximum(chord - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + code: the change of the prediction and the next step index."""
    code, step = np.tile(np.arange(16), len(STEPS)), np.repeat(STEPS, 16)
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.repeat(np.arange(len(STEPS)), 16) + INDEX_CHANGE[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32), (after * 16).astype(np.int32)


MULAW_SAMPLES, ALAW_SAMPLES = mulaw_table(), alaw_table()
ADPCM_CHANGE, ADPCM_NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (columns) of each block (rows of bytes): little-endian start value, step index, a reserved byte, then codes, low half first."""
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    at = 1
    for row in codes:
        for code in (row & 15, row >> 4):
            k = state + code
            value = np.clip(value + ADPCM_CHANGE[k], -32768, 32767)
            state = ADPCM_NEXT[k]
            out[at] = value
            at += 1
    return out.T


def resample(samples: np.ndarray, up: int, down: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample is held."""
    n = len(samples) * up // down
    place = np.arange(n, dtype=np.int64) * down
    left, part = np.divmod(place, up)
    wide = samples.astype(np.int64)
    right = wide[np.minimum(left + 1, max(len(samples) - 1, 0))]
    return ((wide[left] * (up - part) + right * part) // up).astype(np.int16)


def wave(payload: bytes, tag: int = MULAW, bits: int = 8, rate: int = RATE) -> bytes:
    """A one-channel WAVE file; the payload is padded to even length outside the data chunk's size."""
    extra = b"" if tag == PCM else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, bits // 8, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(payload))
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + fact + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(stored: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and payload of a WAVE file, chunk by chunk."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        if name == b"data":
            return tag, rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expanded(payload: bytes, kind: str) -> np.ndarray:
    """The samples of a payload of mu-law or A-law codes or of ADPCM blocks (a shorter last block is padded with zeros)."""
    raw = np.frombuffer(payload, np.uint8)
    if kind == "adpcm":
        return decode_adpcm(np.pad(raw, (0, -len(raw) % BLOCK)).reshape(-1, BLOCK)).ravel()
    return (MULAW_SAMPLES if kind == "mulaw" else ALAW_SAMPLES)[raw]


def stored(payload: bytes, kind: str, up: int, down: int) -> tuple[bytes, bytes]:
    """The WAVE file of a payload, and that of its samples as 16-bit PCM resampled by up / down."""
    tag = {"mulaw": MULAW, "alaw": ALAW, "adpcm": ADPCM}[kind]
    return wave(payload, tag), wave(resample(expanded(payload, kind), up, down).astype("<i2").tobytes(), PCM, 16, RATE * up // down)


def _features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """Of each payload and its stored PCM, from integers: mean size of its samples as mu-law, A-law and ADPCM, and mean size and checksum of the PCM."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    starts = np.cumsum(sizes) - sizes
    mean_mulaw = np.add.reduceat(np.abs(MULAW_SAMPLES.astype(np.int32))[data], starts, dtype=np.int64) // sizes
    mean_alaw = np.add.reduceat(np.abs(ALAW_SAMPLES.astype(np.int32))[data], starts, dtype=np.int64) // sizes
    decoded = decode_adpcm(data.reshape(-1, BLOCK))
    per_block = np.abs(decoded.astype(np.int32)).sum(axis=1, dtype=np.int64)
    mean_adpcm = np.add.reduceat(per_block, starts // BLOCK) // (sizes // BLOCK * decoded.shape[1])
    mean_pcm = [int(np.abs(np.frombuffer(p, "<i2").astype(np.int32)).sum(dtype=np.int64)) * 2 // len(p) for p in pcm]
    return [
        f"mulaw={m};alaw={a};adpcm={d};pcm16k={s};pcm16k_crc={zlib.crc32(p):08x}"
        for m, a, d, s, p in zip(mean_mulaw.tolist(), mean_alaw.tolist(), mean_adpcm.tolist(), mean_pcm, pcm, strict=True)
    ]


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text stored as telephony audio, and of its resampled PCM, both read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1 << 20):
                texts = [(t or "").encode() for t in b["text"].to_pylist()]
                both = [stored(padded(t), "mulaw", 2, 1) for t in texts]
                media, resampled = [m for m, _ in both], [p for _, p in both]
                back, pcm = ([read_wave(m)[2] for m in files] for files in (media, resampled))
                columns = {
                    "doc_id": b["doc_id"],
                    "n_bytes": pa.array(map(len, texts), pa.int64()),
                    "payload_bytes": pa.array(map(len, back), pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                    "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                    "media_bytes": pa.array(map(len, media), pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    "feature": pa.array(_features(back, pcm)),
                    "pcm_bytes": pa.array(map(len, resampled), pa.int64()),
                    "pcm_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in resampled]),
                }
                yield pa.record_batch(list(columns.values()), list(columns))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def add_media(df: DataFrame, payload_col: str, kind: str = "mulaw", id_col: str = "doc_id", up: int = 2, down: int = 1) -> DataFrame:
    """(doc_id, media binary, pcm binary): the WAVE file of each payload and a WAVE file of its samples as PCM, resampled by up / down.

    kind: mulaw, alaw, or adpcm (whole blocks; a shorter last block is padded with zeros)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "payload", 1 << 20):
                got = [stored(p or b"", kind, up, down) for p in b["payload"].to_pylist()]
                yield pa.record_batch([b["doc_id"], pa.array([x for x, _ in got], pa.binary()), pa.array([y for _, y in got], pa.binary())], ["doc_id", "media", "pcm"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(payload_col).alias("payload")).mapInArrow(work, "doc_id long, media binary, pcm binary")
