"""Language identification with language-bitmask n-gram filters.

Training takes a bounded sample of labelled texts per language and counts, for each byte n-gram, the texts of each
language that hold it. An n-gram enters a language's Bloom filter if enough of that language's texts hold it. The
filters are bit-sliced: one array whose slot s holds a bit per language, so the masks at an n-gram's few slots,
and-ed, give all languages that contain it at once. A text is read whole: every n-gram is looked up, the bits are
counted per language, the counts are corrected for the filter's false positives (known from the share of set bits)
and the highest corrected count decides. Its share of all corrected counts is the score.

Texts that are null or have no letter get `und` and score 0; so does every text where nothing has been learned. A tie
goes to the language whose name sorts first. The score says which language is likeliest, not whether the text is in any;
for that, keep() asks what share of the text's own n-grams the best language knows, and calibrate() learns how much of
it labelled texts have. Rows are independent (no shuffle); repeated rows repeat; an empty table
gives an empty result; only the id, text and (in training) language columns are used. What the driver gets is bounded:
SAMPLE_DOCS texts per language give at most GRAMS n-grams per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: About so many labelled texts per language are used, chosen by hash; n-grams per language in the filters.
SAMPLE_DOCS, GRAMS = 1_500, 20_000
#: Bytes of an n-gram; share of a language's texts that must hold it; slots looked up per n-gram; slots per n-gram.
N, LEAST_SHARE, HASHES, ROOM = 5, 0.02, 3, 16
UNKNOWN = "und"
#: For keep(): every how many-th labelled text calibrates; the part of a language's low evidence that is enough; the share of its texts below that low; steps of the histogram.
FOLDS, LEAST_PART, LOW_SHARE, STEPS = 5, 0.25, 0.05, 1_000


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the N bytes from each place on; capital A-Z count as small ones."""
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    if len(low) < N:
        return np.zeros(0, np.uint64)
    key = np.zeros(len(low) - N + 1, np.uint64)
    for i in range(N):
        key = key << np.uint64(8) | low[i : len(low) - N + 1 + i]
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key ^ key >> np.uint64(32)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # (words, size) of uint64: a bit per language
    false_rate: np.ndarray  # per language

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        """The languages that hold each n-gram, 64 of them in a word."""
        size = np.uint64(self.slots.shape[1] - 1)
        out = [w[(hashes & size).astype(np.int64)] for w in self.slots]
        for i in range(1, HASHES):
            place = ((hashes >> np.uint64(21 * i)) & size).astype(np.int64)
            out = [o & w[place] for o, w in zip(out, self.slots, strict=True)]
        return out


def build(grams: dict[str, np.ndarray]) -> Filters:
    """Filters of each language's n-gram hashes."""
    languages = sorted(grams)
    most = max((len(g) for g in grams.values()), default=0)
    size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * ROOM))))
    size = min(size, 1 << 21)
    slots = np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64)
    rate = np.zeros(len(languages))
    for i, name in enumerate(languages):
        h, bit = grams[name].astype(np.uint64), np.uint64(1 << i % 64)
        for j in range(HASHES):
            slots[i // 64][((h >> np.uint64(21 * j)) & np.uint64(size - 1)).astype(np.int64)] |= bit
        rate[i] = float((slots[i // 64] & bit > 0).mean()) ** HASHES
    if len(languages) <= 8:  # a byte per slot stays in the CPU's cache
        return Filters(languages, slots.astype(np.uint8), rate)
    return Filters(languages, slots, rate)


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS) -> Filters:
    """Filters from (doc_id, text, lang); rows without a language or text are ignored."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return build({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, sample_docs / n) * (1 << 30)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=2 << 20):
                lang = np.array(b["lang"].to_pylist(), object)
                found = [np.unique(gram_hashes(np.frombuffer(t.encode(), np.uint8))) for t in b["text"].to_pylist()]
                for name in sorted(set(lang)):
                    own = [g for g, x in zip(found, lang, strict=True) if x == name]
                    h, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    taken = {k: min(n, sample_docs) for k, n in sizes.items()}
    least = F.create_map(*[F.lit(x) for k, n in taken.items() for x in (k, max(1.0, LEAST_SHARE * n))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    common = counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).withColumn("rank", rank).where(F.col("rank") <= grams).select("lang", "gram").collect()  # at most GRAMS of each language
    got: dict[str, list[int]] = {k: [] for k in sizes}
    for r in common:
        got[r["lang"]].append(r["gram"])
    return build({k: np.sort(np.array(v, np.int64)).view(np.uint64) for k, v in got.items()})


def _hits(filters: Filters, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: whether it has a letter, its number of n-grams, and each language's corrected count of them."""
    n = len(texts)
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    texts = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    # every text between N - 1 NULs, so that no n-gram joins two texts unless it holds a NUL; blanks mark both ends
    raw = np.frombuffer(("\0" * (N - 1)).join([f" {t} " for t in texts.to_pylist()]).encode(), np.uint8)
    starts = np.cumsum(sizes + 2 + N - 1) - (sizes + 2 + N - 1)
    masks = filters.masks(gram_hashes(raw))
    total = np.maximum(sizes + 2 - N + 1, 0).astype(np.float64)
    counts = np.zeros((n, len(filters.languages)))
    ends = starts + np.maximum(sizes + 2 - N + 1, 0)
    bounds = np.stack([starts, ends], axis=1).ravel()
    for i in range(len(filters.languages)):
        word = masks[i // 64]
        bits = np.concatenate([[0], np.cumsum(word >> word.dtype.type(i % 64) & word.dtype.type(1), dtype=np.int64)])
        at = bits[np.minimum(bounds, len(bits) - 1)].reshape(-1, 2)
        counts[:, i] = at[:, 1] - at[:, 0]
    return letters, total, np.maximum(counts - total[:, None] * filters.false_rate, 0) / (1 - np.minimum(filters.false_rate, 0.999))


def classify(filters: Filters, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    if not filters.languages or not n:
        return [UNKNOWN] * n, np.zeros(n)
    letters, _, fair = _hits(filters, texts)
    winner, whole = fair.argmax(1), fair.sum(1)
    score = np.where(letters, np.where(whole > 0, fair.max(1) / np.maximum(whole, 1e-9), 1 / len(filters.languages)), 0.0)
    return [filters.languages[w] if ok else UNKNOWN for w, ok in zip(winner.tolist(), letters.tolist(), strict=True)], score


def evidence(filters: Filters, texts: pa.Array) -> np.ndarray:
    """(texts, languages): the share of each text's n-grams that a language knows, corrected; 0 for a text without letters."""
    if not filters.languages or not len(texts):
        return np.zeros((len(texts), len(filters.languages)))
    letters, total, fair = _hits(filters, texts)
    return np.where(letters[:, None], np.minimum(fair / np.maximum(total, 1)[:, None], 1.0), 0.0)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    model = docs.sparkSession.sparkContext.broadcast(filters)  # at most 2 MB for each 8 languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1 << 20):
                names, score = classify(model.value, b["text"])
                yield pa.record_batch([b["doc_id"], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, lang_pred string, score double")


def calibrate(labelled: DataFrame) -> dict[str, float]:
    """The least evidence of each language: LEAST_PART of what all but LOW_SHARE of its texts have in filters learned without them.

    Every FOLDS-th labelled text is measured with filters of the others; a language without such texts gets 0."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(FOLDS))
    filters = train(rows.where(part != 0))
    model = labelled.sparkSession.sparkContext.broadcast(filters)
    place = {name: i for i, name in enumerate(filters.languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1 << 20):
                own = np.array([place.get(x, -1) for x in b["lang"].to_pylist()], np.int64)
                known = np.flatnonzero(own >= 0)
                share = evidence(model.value, b["text"])[known, own[known]]
                yield pa.record_batch([b["lang"].take(pa.array(known)), pa.array((share * STEPS).astype(np.int32))], ["lang", "step"])

    counts = rows.where(part == 0).select("lang", "text").mapInArrow(work, "lang string, step int").groupBy("lang", "step").count().collect()  # STEPS + 1 rows a language at most
    least: dict[str, float] = {}
    for name in filters.languages:
        of = sorted((r["step"], r["count"]) for r in counts if r["lang"] == name)
        if of:
            below = np.cumsum([n for _, n in of])
            least[name] = LEAST_PART * of[int(np.searchsorted(below, LOW_SHARE * below[-1], "right"))][0] / STEPS
    return least


def keep(docs: DataFrame, filters: Filters, least: dict[str, float]) -> DataFrame:
    """The rows of docs (with a text column) whose best language knows at least its `least` share of the text's n-grams, and any at all; unchanged, no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(filters)
    enough = np.array([least.get(name, 0.0) for name in filters.languages])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=1 << 20):
                share = evidence(model.value, b["text"])
                if not share.size:
                    yield b.slice(0, 0)
                    continue
                best = share.max(1)
                yield b.filter(pa.array((best > 0) & (best >= enough[share.argmax(1)])))

    return docs.mapInArrow(work, docs.schema)
