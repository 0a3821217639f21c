"""Words of whole texts as 64-bit hashes, without a Python object per word.

Words are runs of bytes other than blank and 09-0D, with A-Z as a-z. The hash is a polynomial modulo 2**64 over a
random number per byte, taken from prefix sums (the multiplier is odd, so its powers have inverses), then mixed.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _per_byte() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values


BYTE = _per_byte()
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, factor in (("up", _MULTIPLIER), ("down", _INVERSE)):
            table = np.ones(size, np.uint64)
            filled = 1
            step = factor
            while filled < size:  # doubling: the second half is the first times factor**filled
                take = min(filled, size - filled)
                table[filled : filled + take] = table[:take] * step
                with np.errstate(over="ignore"):
                    step, filled = step * step, filled + take
            _powers[name] = table
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def joined(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a blank after each, as bytes, and where each begins (one more entry: the end)."""
    parts = [t.encode() if isinstance(t, str) else (t or b"") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    return np.frombuffer(b" ".join([*parts, b""]), np.uint8), starts


def spans(raw: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; the last byte is white space. gap: which bytes are no part of a word."""
    solid = ~gap[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def words(raw: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word (see spans)."""
    start, end = spans(raw, gap)
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[: len(raw)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def per_text(starts: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Index of the first word of each text (one more entry: the number of words)."""
    return np.searchsorted(word_starts, starts)
