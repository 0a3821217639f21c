"""Ranked lexical search, score at a time over impact-ordered postings.

Terms are runs of digits, ASCII letters (A-Z as a-z) and characters beyond ASCII. A term's posting for a document has an
integer impact: the term's weight times a fraction of its occurrences, which falls with the document's length. The first
pass counts documents, terms and, for the terms that items ask for, the documents holding them. The second builds for
each shard (about SHARD bytes of text of one task) the postings of the asked terms in descending order of exact impact.
Every item is then searched in every shard score at a time: the postings of its terms are merged by descending impact
and added up group by group of equal impact; for each term the next impact bounds what it can still give, so the search
stops once the sum of these bounds is below the K-th best sum so far. Documents that could still reach that sum get their
scores completed from the shard's postings by document; all others provably can't be among the best K, ties included. A
shard gives K rows an item at most, and the best of all shards are taken by window limits, which Spark applies before it
shuffles too, first within groups of shards.

Terms are known by a 64-bit hash (see words.py). Items are searched in blocks of about PAIRS (item, term) pairs, so what
is broadcast is bounded; a block reads the documents once more. Sums, bounds and lengths are 64-bit integers; where the
product for a length would not fit in 64 bits, Python's integers take over.

Documents whose text is null, empty or without a term aren't counted and never found. Repeated rows are documents of
their own; ids are integers, and null ones come after all others among equal scores. Rows of one item_id (null too) are one item with all
their terms; an item without terms, or without a document above 0, has no rows. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices
from .words import joined, per_text, words

#: Documents of an item's answer; bytes of text of a shard and of a step within; pairs of items and terms searched at once.
K, SHARD, SLICE, PAIRS = 50, 32 << 20, 4 << 20, 1 << 20
#: Postings added up between two looks at the bounds, at first; doubled each time.
STEP = 2_048
#: Bytes that are no part of a term.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The term hashes of all texts, and where each text's begin (one more entry: the end)."""
    raw, starts = joined(texts)
    begin, _, h = words(raw, GAP)
    return h, per_text(starts, begin)


def _asked(items: DataFrame, id_col: str, text_col: str, pairs: int) -> tuple[DataFrame, int]:
    """(item, block, term) without repetitions, of items (item: id), and the number of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                h, first = _terms(b["text"].to_pylist())
                whose = np.repeat(np.arange(len(b)), np.diff(first))
                yield pa.record_batch([b["item"].take(pa.array(whose)), pa.array(h.view(np.int64))], ["item", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(work, f"item {kind}, term long").distinct()
    found = kept(rows, "lexical-items")
    blocks = max(1, -(-found.count() // pairs))
    return found.select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "term"), blocks


def _counted(docs: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each of `terms` (sorted)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        holds, n, total = np.zeros(len(asked), np.int64), 0, 0
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                h, first = _terms(b["text"].to_pylist())
                sizes = np.diff(first)
                n, total = n + int((sizes > 0).sum()), total + len(h)
                at, whose = _known(h, np.repeat(np.arange(len(sizes)), sizes), asked)
                holds += np.bincount(np.unique(whose * len(asked) + at) % max(1, len(asked)), minlength=len(asked))
        seen = np.flatnonzero(holds)
        yield pa.record_batch([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(holds[seen], [n, total]))], ["at", "n"])

    got = docs.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row a term at most
    n = {r["at"]: r["n"] for r in got}
    return n.get(-1, 0), n.get(-2, 0), np.array([n.get(i, 0) for i in range(len(terms))], np.int64)


def _known(h: np.ndarray, whose: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the hashes that are in `asked` (sorted): their places there, and their documents."""
    if not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
    found = asked[at] == h
    return at[found], whose[found]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def spread(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What divides a document's occurrences: 50, and 50 more for a document of mean length."""
    if len(length) and 50 * int(length.max()) * n >= 1 << 63:
        return np.array([50 + 50 * x * n // total for x in length.tolist()], object)
    return 50 + 50 * length * n // max(1, total)


def _impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))).astype(np.int64)


class Shard:
    """The postings of the asked terms in some documents: by term in descending order of impact, and by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.edge = np.searchsorted(term[order], np.arange(n_terms + 1))
        by_doc = np.lexsort((term, doc))
        self.by_doc = doc[by_doc], term[by_doc], impact[by_doc]
        self.sums = np.zeros(int(doc.max()) + 1 if len(doc) else 0, np.int64)

    def search(self, terms: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents that can be among the best k for these terms, with their full scores, and how many postings were added up."""
        spans = [(int(self.edge[t]), int(self.edge[t + 1])) for t in terms.tolist()]
        spans = [(a, z) for a, z in spans if z > a]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        impact = np.concatenate([self.impact[a:z] for a, z in spans])
        doc = np.concatenate([self.doc[a:z] for a, z in spans])
        whose = np.repeat(np.arange(len(spans)), [z - a for a, z in spans])
        order = np.argsort(-impact, kind="stable")
        impact, doc, whose = impact[order], doc[order], whose[order]
        edges = np.append(np.flatnonzero(impact[1:] != impact[:-1]) + 1, len(impact))  # ends of the groups of equal impact
        given, at = np.zeros(len(spans), np.int64), 0
        starts, sums = np.array([a for a, _ in spans]), self.sums
        lengths = np.array([z - a for a, z in spans])
        while True:
            to = int(edges[min(np.searchsorted(edges, at + step), len(edges) - 1)])
            np.add.at(sums, doc[at:to], impact[at:to])
            given += np.bincount(whose[at:to], minlength=len(spans))
            at, step = to, 2 * step
            seen = np.unique(doc[:at])
            left = given < lengths
            rest = int(self.impact[(starts + given)[left]].sum())  # what a document can still gain, at most
            reached = sums[seen]
            least = int(np.partition(reached, -k)[-k]) if len(seen) >= k else 0
            if at == len(doc) or rest < least:
                break
        able = seen[reached + rest >= least] if rest else seen[reached >= least]
        sums[seen] = 0
        return able, self._complete(able, terms) if rest else reached[reached >= least], at

    def _complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The full scores of sorted documents."""
        doc, term, impact = self.by_doc
        a, z = np.searchsorted(doc, docs), np.searchsorted(doc, docs, "right")
        n = z - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        scores = np.zeros(len(docs), np.int64)
        ours = np.isin(term[at], terms)
        np.add.at(scores, np.repeat(np.arange(len(docs)), n)[ours], impact[at[ours]])
        return scores


def _best(ids: pa.Array, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k by score, then by id; null ids last."""
    docs, scores = docs[scores > 0], scores[scores > 0]
    if len(docs) > k:
        least = np.partition(scores, -k)[-k]
        docs, scores = docs[scores >= least], scores[scores >= least]
    own = ids.take(pa.array(docs))
    null = np.asarray(own.is_null())
    value = np.asarray(own.fill_null(0))
    order = np.lexsort((value, null, -scores))[:k]
    return docs[order], scores[order]


def _searched(docs: DataFrame, asked: np.ndarray, w: np.ndarray, n: int, total: int, items: list[np.ndarray], k: int) -> DataFrame:
    """(item, shard, doc_id, score): the best k of each shard (named by its task) for each item (its place in `items`, its terms' places in `asked`)."""
    shared = docs.sparkSession.sparkContext.broadcast((asked, w, items))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w, items = shared.value
        held, size, count = [], 0, 0

        def shard() -> Iterator[pa.RecordBatch]:
            ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            term, doc, impact = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            index = Shard(term, doc, impact, len(asked))
            out = [(i, *_best(ids, *index.search(t, k)[:2], k)) for i, t in enumerate(items)]
            out = [x for x in out if len(x[1])]
            if out:
                sizes = [len(x[1]) for x in out]
                item = np.repeat([x[0] for x in out], sizes)
                found = np.concatenate([x[1] for x in out])
                yield pa.record_batch([pa.array(item), pa.array(np.full(len(item), TaskContext.get().partitionId())), ids.take(pa.array(found)), pa.array(np.concatenate([x[2] for x in out]))], ["item", "shard", "doc_id", "score"])

        for batch in batches:
            for b in slices(batch, limit=SLICE):
                h, first = _terms(b["text"].to_pylist())
                sizes = np.diff(first)
                at, whose = _known(h, np.repeat(np.arange(len(sizes)), sizes), asked)
                pair, tf = np.unique(whose * len(asked) + at, return_counts=True)
                whose, at = pair // max(1, len(asked)), pair % max(1, len(asked))
                impact = _impacts(w[at], tf, spread(sizes, n, total)[whose])
                whole = impact > 0
                held.append((b["doc_id"], at[whole], whose[whole] + count, impact[whole]))
                count += len(b)
                size += len(h) * 6 + 64 * len(b)
                if size >= SHARD:
                    yield from shard()
                    held, size, count = [], 0, 0
        if held:
            yield from shard()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"item long, shard long, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best k documents of each item by score, then by doc_id; rank from 1."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted, blocks = _asked(items, item_col, item_text, pairs)
    out = []
    for block in range(blocks):
        found = wanted.where(F.col("block") == block).select("item", "term").collect()  # about `pairs` rows
        terms = np.unique(np.array([r["term"] for r in found], np.int64).view(np.uint64))
        names = sorted({r["item"] for r in found}, key=lambda x: (x is None, x))
        n, total, holds = _counted(rows, terms)
        place = {x: i for i, x in enumerate(names)}
        whose = np.array([place[r["item"]] for r in found], np.int64)
        at = np.searchsorted(terms, np.array([r["term"] for r in found], np.int64).view(np.uint64))
        order = np.lexsort((at, whose))
        each = np.split(at[order], np.flatnonzero(np.diff(whose[order])) + 1) if len(order) else []
        w = np.array([weight(n, int(d)) for d in holds], np.int64)
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item long, item_id {items.schema[item_col].dataType.simpleString()}")
        out.append(_searched(rows, terms, w, n, total, each, k).join(F.broadcast(ids), "item"))
    best = out[0]
    for more in out[1:]:
        best = best.union(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", F.pmod("shard", F.lit(64))).orderBy(*order))).where(F.col("rank") <= k)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
