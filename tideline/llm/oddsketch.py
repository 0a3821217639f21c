"""Near-duplicates by MinHash bands and odd sketches, links confirmed on the full sets.

A document's set holds the distinct 64-bit hashes of its WORDS-word shingles. SAMPLES hash functions give its MinHash
samples, of which BANDS bands of ROWS samples each are its signatures: two sets of similarity 0.85 share none of their
bands with a probability below 1e-10 (a band agrees with probability 0.85 ** 4). All samples, each with the number of
its function, are folded into the parity bits of an odd sketch. In the exclusive or of two sketches only samples that
differ count, so its population count tells the similarity, most precisely where it is high; the fewer samples differ
the less they meet in a bit. A pair goes to the full comparison unless its count is above MOST_BITS, which a pair of
similarity 0.85 or more exceeds with a probability below 1e-10 (computed from the binomial number of differing samples
and the walk of the count as they are folded in) or the parities of the full sets already forbid it (see jaccard.py).

Bands are grouped, large groups are kept as members instead of pairs, links are confirmed on the full sets and their
classes found as described in jaccard.py; equal sets count as one throughout, and nothing about documents is gathered
on the driver. Null and empty texts have no set, are linked with nothing and stand alone; fewer words than WORDS make
one shingle of all. Repeated rows share a class. A class whose rows all have null ids has a null component_id. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .words import mix

WORDS, PERCENT = 3, 85
#: MinHash samples; bands and their rows; bits of a sketch.
SAMPLES, BANDS, ROWS, BITS = 256, 32, 4, 512
#: Probability with which a linked pair may be lost by its sketches.
LOSS = 1e-10
#: Shingles hashed at once.
AT_ONCE = 512
_SALTS = np.random.default_rng(85).integers(1, 1 << 63, SAMPLES // 2, dtype=np.uint64)
_FACTORS = np.random.default_rng(86).integers(1, 1 << 62, SAMPLES // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples (32 bits each) of a set that isn't empty; a product's two halves serve two functions."""
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), AT_ONCE):
        h = (s[at : at + AT_ONCE, None] ^ _SALTS) * _FACTORS
        h ^= h >> np.uint64(29)
        np.minimum(least, h.view(np.uint32).min(axis=0), out=least)
    return least


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every set's bands: (index of the set, hash of the band's samples and number)."""
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    band = np.stack([samples(s)[: BANDS * ROWS] for s in sets]).reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    h = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + band[:, :, r] + np.uint64(1))
    h = mix(h ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))
    return np.repeat(np.arange(len(sets)), BANDS), h.ravel()


def sketch(s: np.ndarray) -> bytes:
    """The odd sketch: each bit is the parity of the samples that fall on it."""
    own = mix(samples(s).astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    odd = np.bincount((own >> np.uint64(11)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


@cache
def most_bits(percent: int = PERCENT, loss: float = LOSS) -> int:
    """The least count of differing sketch bits that a pair of this similarity exceeds with at most this probability."""
    apart = 1 - percent / 100
    walk = np.zeros(BITS + 1)  # of the number of odd bits after so many samples
    walk[0] = 1.0
    bits, total = np.arange(BITS + 1), np.zeros(BITS + 1)
    for differ in range(SAMPLES + 1):
        total += comb(SAMPLES, differ) * apart**differ * (1 - apart) ** (SAMPLES - differ) * walk
        for _ in range(2):  # a sample that differs folds one bit in for either set
            up, down = walk * (BITS - bits) / BITS, walk * bits / BITS
            walk = np.zeros(BITS + 1)
            walk[1:] += up[:-1]
            walk[:-1] += down[1:]
    beyond = np.cumsum(total[::-1])[::-1]  # of at least so many
    return int(np.flatnonzero(beyond <= loss)[0]) - 1


def estimate(a: bytes, b: bytes) -> float:
    """The similarity that two sketches tell; those too far apart for the estimate give 0."""
    odd = int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
    return max(0.0, 1 + BITS / (4 * SAMPLES) * np.log1p(-2 * odd / BITS)) if 2 * odd < BITS else 0.0


SCHEME = jaccard.Scheme(WORDS, PERCENT, signatures, sketch, BITS // 8, most_bits())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the size of each row's set, the smallest doc_id of its class, and whether the row is that one; null ids are never kept."""
    got = jaccard.classes(docs, id_col, text_col, SCHEME)
    return got.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
