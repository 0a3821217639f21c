"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text's terms are how it is written and how its words begin: grams of a reduced character string (runs of small
letters, capitals, digits and blanks count as one; every other sign stands for its group), hashed word beginnings, and words
that come again at once. From a bounded, documented sample of labelled rows, as many of each label, come the term
weights, the latent space (leading eigenvectors of the weighted term products) and the labelled vectors. They are
broadcast (their size is fixed by the parameters). For every document all cosine products with all labelled vectors
are computed in blocks, exactly, and the NEAREST labels vote, weighted by a power of their similarity.

A text without terms (null, empty) and every text where nothing was labelled gets the sample's share of label 1, or
0.5. Where several labelled texts are equally near at the last place, they share what is left of the vote. Rows are independent (no shuffle); repeated
rows repeat; an empty table gives an empty result; only id and text are used, and labels in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import words

#: Labelled rows of each label that are used at most, about; terms of each sort; latent dimensions; voters; power of the similarity.
SAMPLE_EACH, SHAPES, WORDS, REPEATS, LATENT, NEAREST, POWER = 1_500, 752, 256, 16, 48, 15, 8.0
WIDTH = SHAPES + WORDS + REPEATS
#: Score from which a document counts as good.
GOOD = 0.3
#: Documents whose products with all labelled vectors are held at once.
BLOCK = 512


def _groups() -> np.ndarray:
    """Of each byte: 0 small letter (and any byte beyond ASCII), 1 capital, 2 digit, 3 white space, then groups of signs."""
    out = np.zeros(256, np.uint8)
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[*range(9, 14), 32, 0]] = 3
    signs = [".", ",;:", "!?", "'\"`", "|/\\", "#$%&*@", "<>[]{}()", "=+-_~^"]
    for i, group in enumerate(signs):
        out[[ord(c) for c in group]] = 4 + i
    return out


GROUPS = _groups()


def terms(texts: list[str]) -> np.ndarray:
    """Term counts: a row for each text."""
    parts = [t.encode() for t in texts]
    raw = np.frombuffer(b"\0".join([b"", *parts, b""]), np.uint8)  # a NUL before the first text and after each
    owner = np.concatenate([[-1], np.repeat(np.arange(len(texts)), [len(p) + 1 for p in parts])]).astype(np.int32)
    width = WIDTH
    group = GROUPS[raw]
    kept = np.flatnonzero((group != np.concatenate([[255], group[:-1]])) | (group > 3))
    seq, whose = group[kept].astype(np.int64), owner[kept]
    keys = []
    if len(seq) >= 4:
        gram = seq[:-3] * 4096 + seq[1:-2] * 256 + seq[2:-1] * 16 + seq[3:]
        same = whose[:-3] == whose[3:]
        keys.append(whose[:-3][same].astype(np.int64) * width + (gram[same] * 40503 >> 4) % SHAPES)
    begin = np.flatnonzero((group[:-3] == 3) & (group[1:-2] < 2))
    if len(begin):
        low = raw | 32
        word = low[begin + 1].astype(np.int64) << 16 | low[begin + 2].astype(np.int64) << 8 | low[begin + 3]
        same = owner[begin + 1] == owner[np.minimum(begin + 3, len(owner) - 1)]
        keys.append(owner[begin + 1][same].astype(np.int64) * width + SHAPES + (word[same] * 2654435761 >> 7) % WORDS)
    starts, _, word = words(np.where(raw == 0, np.uint8(32), raw))
    if len(starts) > 1:
        again = np.flatnonzero((word[1:] == word[:-1]) & (owner[starts[1:]] == owner[starts[:-1]])) + 1
        keys += [owner[starts[again]].astype(np.int64) * width + SHAPES + WORDS + i for i in range(REPEATS)]
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return np.bincount(flat, minlength=len(texts) * width).reshape(len(texts), width).astype(np.float32)


@dataclass
class Voters:
    weights: np.ndarray  # of terms
    space: np.ndarray  # terms by latent dimensions
    vectors: np.ndarray  # labelled vectors of length 1
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[str]) -> np.ndarray:
        x = np.log1p(terms(texts)) * self.weights
        z = x @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), BLOCK):
            z = self.latent(texts[at : at + BLOCK])
            if not len(self.labels):
                out.append(np.full(len(z), self.prior))
                continue
            cos = z @ self.vectors.T
            k = min(NEAREST, cos.shape[1])
            out.append(self._vote(cos, k))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)

    def _vote(self, cos: np.ndarray, k: int) -> np.ndarray:
        last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
        who, near = np.nonzero(cos >= last[:, None])
        similar = cos[who, near]
        tied = similar == last[who]
        above = np.bincount(who[~tied], minlength=len(cos))
        share = np.where(tied, ((k - above) / np.maximum(np.bincount(who[tied], minlength=len(cos)), 1))[who], 1.0)
        w = share * np.maximum(similar, 0).astype(np.float64) ** POWER
        whole = np.bincount(who, weights=w, minlength=len(cos))
        vote = np.bincount(who, weights=w * self.labels[near], minlength=len(cos)) / np.maximum(whole, 1e-300)
        return np.where(whole > 1e-9, vote, self.prior)


def train(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH) -> Voters:
    """Voters from docs (doc_id, text) and labels (doc_id, label 0 or 1); other labels and null ones are ignored.

    The sample is drawn from the labels, so what is joined to the texts is small and broadcast: no text is shuffled."""
    rows = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows at most
    width = WIDTH
    if not sizes:
        return Voters(np.ones(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    limit = F.when(F.col("label") == 1, int(min(1, sample_each / sizes.get(1, 1)) * (1 << 30))).otherwise(int(min(1, sample_each / sizes.get(0, 1)) * (1 << 30)))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit).select("doc_id", "label").distinct()  # so that its size is bounded where ids repeat
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # about 2 * sample_each rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                x = terms(pc.fill_null(b["text"], "").to_pylist())
                yield pa.record_batch([b["doc_id"], b["label"], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "terms"])

    # about 2 * SAMPLE_EACH rows of 4 KB; rows that repeat count once, and ids that repeat with other texts are bounded too
    got = sample.mapInArrow(count, "doc_id long, label int, terms binary").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label", "terms").limit(4 * sample_each).collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["terms"]))
    tf = np.frombuffer(b"".join(r["terms"] for r in got), np.float32).reshape(-1, width)
    labels = np.array([r["label"] for r in got], np.float64)
    x = np.log1p(tf)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x = x * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    space = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT], np.float32)
    z = x @ space
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return Voters(weights, space, z, labels, float(labels.mean()) if len(labels) else 0.5)


def predict(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every text."""
    model = docs.sparkSession.sparkContext.broadcast(voters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1 << 20):
                yield pa.record_batch([b["doc_id"], pa.array(model.value.score(pc.fill_null(b["text"], "").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, score double")


def keep(docs: DataFrame, voters: Voters, least: float = GOOD) -> DataFrame:
    """The rows of docs (with a text column) whose score is high enough, unchanged; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(voters)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1 << 20):
                yield b.filter(pa.array(model.value.score(pc.fill_null(b["text"], "").to_pylist()) >= least))

    return docs.mapInArrow(work, docs.schema)
