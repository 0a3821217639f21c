"""Phrase collocations: frequent n-grams of dictionary ids, counted by a range-partitioned radix sort and run lengths.

Texts are cut into pieces at PIECE bytes and those into words at blanks and tabs, A-Z as a-z; everything is per language.
The first pass counts words. A phrase of MIN occurrences has only words of as many, so those get dense ids over all
languages (an id implies its language) and every other word breaks a piece. The second pass turns each word that has a
successor into one fixed-width key: its id and those of up to four words after it in its piece, 32 bits each, zeros
behind the break. Keys are radix-sorted and combined within a slice of text, dealt out by ranges of keys (edges from a
sample of documents), and sorted and merged in each range. In sorted order the occurrences of a phrase of 2 to 5 words
are a run of keys with that prefix, so one sort counts all lengths. A run may cross into the next range, so a range
passes on the counts of its first and last runs whatever they are, and Spark adds up. The rest are joins of candidates:
with one-word-longer ones (if any longer phrase around a candidate is as frequent, so is one that is one word longer),
with the counts of their parts, and with the words of the best.

A dictionary of up to MOST_WORDS words is broadcast (12 bytes each). A larger one is joined: each slice of text asks for
its own different words, and is encoded with the answers. Edges are 20 bytes for each range of PER_RANGE keys, at most
MOST_RANGES; beyond that ranges grow. Words are known by a 64-bit hash (see words.py) with the language's mixed in; counts
of words are by the words themselves. Products are decimals of 38 digits.

Null languages are `und`; null and empty texts have no words. Repeated rows count each time. Empty tables, or tables
without a phrase of MIN occurrences, give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import Stream, ranked

from .common import kept, runs, slices
from .words import mix, words

#: Occurrences of a candidate, words of a phrase, phrases of a language's report.
MIN, LONGEST, TOP = 100, 5, 2_000
#: Bytes of text handled at once; words of a broadcast dictionary; keys of a range, about; ranges; sampled keys a range.
SLICE, MOST_WORDS, PER_RANGE, MOST_RANGES, SAMPLED = 4 << 20, 2_000_000, 2_000_000, 1 << 20, 64
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
#: Bytes that end a piece, and those that end a word.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = PIECE.copy()
GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
Arrays = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of a slice: the bytes; of each word the start, end, hash and number of its language; the languages."""
    parts = [x or b"" for x in pc.cast(batch["text"], pa.binary()).to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    raw = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
    start, end, h = words(raw, GAP)
    coded = batch["lang"].dictionary_encode()
    names = coded.dictionary.to_pylist()
    salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], np.uint64)
    lang = coded.indices.to_numpy()[np.searchsorted(starts, start, "right") - 1]
    return raw, start, end, mix(h ^ salts[lang]), lang, names


def _links(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each word follows the one before it in the same piece."""
    ends = np.cumsum(PIECE[raw])[start]
    return np.diff(ends, prepend=-1) == 0


def _counted(docs: DataFrame) -> DataFrame:
    """(hash, lang, word, f): occurrences of every word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                raw, start, end, h, lang, names = _words(b)
                own, first, n = np.unique(h, return_index=True, return_counts=True)
                sizes = (end - start)[first]
                letters = raw[runs(start[first], sizes)]
                word = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())])
                yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(names, pa.string()).take(pa.array(lang[first])), word.cast(pa.large_string()).cast(pa.string()), pa.array(n)], ["hash", "lang", "word", "f"])

    return docs.mapInArrow(work, "hash long, lang string, word string, f long").groupBy("hash", "lang", "word").agg(F.sum("f").alias("f"))


def packed(ids: list[np.ndarray]) -> list[bytes]:
    """Binary keys of rows of ids: 32 bits each, highest byte first, so that their order is the order of the ids."""
    flat = np.stack(ids, axis=1).astype(">u4").tobytes()
    return [flat[i : i + 4 * len(ids)] for i in range(0, len(flat), 4 * len(ids))]


def encoded(ids: np.ndarray, link: np.ndarray) -> list[np.ndarray]:
    """Columns of the keys of a sequence of ids (0: a break), of which link tells whether each continues a piece."""
    alive, n = ids > 0, len(ids)
    columns = [np.where(alive, ids, 0)]
    for k in range(1, LONGEST):
        ahead, joins = np.zeros(n, ids.dtype), np.zeros(n, bool)
        ahead[: max(0, n - k)], joins[: max(0, n - k)] = ids[k:], link[k:]
        alive = alive & joins & (ahead > 0)
        columns.append(np.where(alive, ahead, 0))
    whole = columns[1] > 0
    return [c[whole].astype(np.uint32) for c in columns]


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their columns: stable passes over 16 bits each, from the lowest; those that are all alike are left out."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        for shift in (0, 16):
            digit = (c >> np.uint32(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def combined(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted rows without repetitions and the sums of n over the equal ones."""
    order = radix_order(columns)
    columns, n = [c[order] for c in columns], n[order]
    if not len(n):
        return columns, n
    fresh = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    at = np.flatnonzero(fresh)
    return [c[at] for c in columns], np.add.reduceat(n, at)


def _ranges(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Where each range begins in sorted keys: the first key not below each edge."""

    def wide(cols: list[np.ndarray]) -> np.ndarray:
        return np.array(packed(cols), f"S{4 * LONGEST + 1}") if len(cols[0]) else np.zeros(0, f"S{4 * LONGEST + 1}")

    lead = [np.uint64(1 << 32) * x[0].astype(np.uint64) + x[1] for x in (columns, edges)]
    low, high = (np.searchsorted(lead[0], lead[1], side) for side in ("left", "right"))
    for i in np.flatnonzero(low < high).tolist():  # keys with an edge's first two ids: compare the rest
        here = wide([c[low[i] : high[i]] for c in columns])
        low[i] += int((here < wide([e[i : i + 1] for e in edges])[0]).sum())
    return low


def _squeezed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted keys and counts, byte plane after byte plane, compressed."""
    first = np.diff(columns[0], prepend=np.uint32(0))
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (first, *columns[1:])]
    return pa.compress(b"".join([*planes, n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()]), codec="zstd", asbytes=True)


def _loosened(data: bytes, rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, rows * (4 * LONGEST + 8), codec="zstd", asbytes=True), np.uint8)
    planes = raw[: rows * 4 * LONGEST].reshape(LONGEST, 4, rows)
    columns = [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]
    columns[0] = np.cumsum(columns[0], dtype=np.uint32)
    return columns, np.ascontiguousarray(raw[rows * 4 * LONGEST :].reshape(8, rows).T).view("<i8").ravel()


def _dealt(rows: DataFrame, arrays: Arrays, edges: list[np.ndarray]) -> DataFrame:
    """(part, rows, data): the combined keys of each slice of text, by range."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, link in arrays(batch):
                columns = encoded(ids, link)
                columns, n = combined(columns, np.ones(len(columns[0]), np.int64))
                cut = np.concatenate([[0], _ranges(columns, shared.value), [len(n)]])
                full = np.flatnonzero(np.diff(cut))
                data = [_squeezed([c[cut[i] : cut[i + 1]] for c in columns], n[cut[i] : cut[i + 1]]) for i in full.tolist()]
                yield pa.record_batch([pa.array(full), pa.array(np.diff(cut)[full]), pa.array(data, pa.binary())], ["part", "rows", "data"])

    return rows.mapInArrow(work, "part long, rows long, data binary")


def _sampled(rows: DataFrame, arrays: Arrays, every: int) -> list[np.ndarray]:
    """Columns of every so-manieth key of the rows, on the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, link in arrays(batch):
                yield pa.record_batch([pa.array(c[every // 2 :: every].astype(np.int64)) for c in encoded(ids, link)], [f"c{i}" for i in range(LONGEST)])

    got = rows.mapInArrow(work, ", ".join(f"c{i} long" for i in range(LONGEST))).toArrow()
    return [got[f"c{i}"].to_numpy().astype(np.uint32) for i in range(LONGEST)]


def phrase_runs(columns: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(ids, occurrences) of each length's phrases in sorted keys: those of `least` occurrences, and the first and last run."""
    fresh = np.zeros(len(n), bool)
    fresh[0] = True
    for size in range(1, LONGEST + 1):
        fresh[1:] |= columns[size - 1][1:] != columns[size - 1][:-1]
        if size == 1:
            continue
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(n, at)
        keep = total >= least
        keep[[0, -1]] = True
        keep &= columns[size - 1][at] > 0
        yield [c[at[keep]] for c in columns[:size]], total[keep]


def _candidates(blocks: DataFrame, least: int) -> DataFrame:
    """(key, a) of all phrases of 2 to LONGEST words with `least` occurrences."""

    def merged(held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [_loosened(d, r) for r, d in held]
        columns, n = combined([np.concatenate([p[0][i] for p in parts]) for i in range(LONGEST)], np.concatenate([p[1] for p in parts]))
        for ids, a in phrase_runs(columns, n, least):
            yield pa.record_batch([pa.array(packed(ids) if len(a) else [], pa.binary()), pa.array(a, pa.int64())], ["key", "a"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, rows, data in zip(batch["part"].to_pylist(), batch["rows"].to_pylist(), batch["data"], strict=True):
                if part != now and held:
                    yield from merged(held)
                    held = []
                now = part
                held.append((rows, data.as_py()))
        if held:
            yield from merged(held)

    found = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(work, "key binary, a long")
    return found.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _joined(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(ids, link) of each slice of text, for a dictionary of any size: a slice asks for its different words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                raw, start, _, h, _, _ = _words(b)
                name = int.from_bytes(hashlib.blake2b(raw.tobytes() + np.random.default_rng().bytes(16), digest_size=8).digest(), "little", signed=True)
                yield pa.record_batch([pa.array([name]), pa.array([h.tobytes()], pa.binary()), pa.array([_links(raw, start).tobytes()], pa.binary())], ["slice", "hashes", "link"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["slice"].to_pylist(), batch["hashes"], strict=True):
                own = np.unique(np.frombuffer(data.as_py(), np.int64))
                yield pa.record_batch([pa.array(np.full(len(own), name)), pa.array(own)], ["slice", "hash"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, link, answers in zip(batch["hashes"], batch["link"], batch["answers"], strict=True):
                h = np.frombuffer(data.as_py(), np.int64).view(np.uint64)
                got = answers.values
                hashes, ids = (np.array([]) if got is None else got.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(hashes.astype(np.int64).view(np.uint64))
                found = _looked_up(h, hashes.astype(np.int64).view(np.uint64)[order], ids.astype(np.uint32)[order])
                yield pa.record_batch([pa.array([found.tobytes()], pa.binary()), pa.array([link.as_py()], pa.binary())], ["ids", "link"])

    cuts = kept(docs.mapInArrow(cut, "slice long, hashes binary, link binary"), "phrases-slices")
    asks = cuts.select("slice", "hashes").mapInArrow(ask, "slice long, hash long")
    answers = asks.join(known.select("hash", "id"), "hash").groupBy("slice").agg(F.collect_list(F.struct("hash", "id")).alias("answers"))
    return kept(cuts.join(answers, "slice").select("hashes", "link", "answers").mapInArrow(encode, "ids binary, link binary"), "phrases-ids")


def _looked_up(h: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of each hash; 0 for one that isn't known."""
    if not len(hashes):
        return np.zeros(len(h), np.uint32)
    own, at = np.unique(h, return_inverse=True)
    near = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    return np.where(hashes[near] == own, ids[near], np.uint32(0))[at]


def _readers(docs: DataFrame, known: DataFrame, size: int, most: int) -> tuple[DataFrame, Arrays]:
    """The rows to read, and how the ids and links of a batch of them come."""
    if size > most:

        def stored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for ids, link in zip(batch["ids"], batch["link"], strict=True):
                yield np.frombuffer(ids.as_py(), np.uint32), np.frombuffer(link.as_py(), bool)

        return _joined(docs, known), stored
    table = known.select("hash", "id").toArrow()
    hashes = table["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], table["id"].to_numpy().astype(np.uint32)[order]))

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in slices(batch, limit=SLICE):
            raw, start, _, h, _, _ = _words(b)
            yield _looked_up(h, *shared.value), _links(raw, start)

    return docs, read


def _edges(rows: DataFrame, arrays: Arrays, total: int, n_rows: int, per_range: int) -> list[np.ndarray]:
    """Columns of the keys that begin each range but the first; from about SAMPLED keys a range, of sampled rows."""
    ranges = min(MOST_RANGES, -(-total // per_range))
    if ranges <= 1:
        return [np.zeros(0, np.uint32)] * LONGEST
    wanted = SAMPLED * ranges
    share = min(1.0, max(10 * wanted / total, 400 / max(1, n_rows)))
    columns = _sampled(rows.sample(share, 11) if share < 1 else rows, arrays, max(1, int(share * total / wanted)))
    columns = [c[radix_order(columns)] for c in columns]
    at = np.unique(np.arange(1, ranges) * len(columns[0]) // ranges)
    edges, _ = combined([c[at] if len(c) else c for c in columns], np.ones(len(at) if len(columns[0]) else 0, np.int64))
    return edges


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN, top: int = TOP, most_words: int = MOST_WORDS, per_range: int = PER_RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, a, phrase."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = kept(_counted(rows), "phrases-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counted.where(F.col("f") >= least).withColumn("all", F.lit(0))
    numbered = ranked(frequent, Stream(["all"], ["hash"], F.shiftright("hash", 52)), "id").join(totals, "lang")
    known = kept(numbered.select("hash", (F.col("id") + 1).alias("id"), "lang", "word", "f", "n"), "phrases-dictionary")
    size, total = known.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    if not size:
        return spark.createDataFrame([], RESULT)
    source, arrays = _readers(rows, known, size, most_words)
    edges = _edges(source, arrays, total, source.count(), per_range)
    found = kept(_candidates(_dealt(source, arrays, edges), least), "phrases-candidates")
    found = found.withColumn("size", (F.octet_length("key") / 4).cast("int"))
    unit = F.unhex(F.lpad(F.hex("id"), 8, "0"))
    parts = found.select("key", F.col("a").alias("f"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n")).union(known.select(unit.alias("key"), "f", "lang", "n"))
    inner = F.explode(F.array(F.expr("substring(key, 1, 4 * size - 4)"), F.expr("substring(key, 5)")))
    around = found.where("size > 2").select(inner.alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    own = found.join(around, "key", "left").where("longer IS NULL OR longer < a").drop("longer")
    cuts = own.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).withColumns({"left": F.expr("substring(key, 1, 4 * k)"), "right": F.expr("substring(key, 4 * k + 1)")})
    for side in ("left", "right"):
        names = [F.col("f").alias(side[0])] + ([F.col("lang"), F.col("n")] if side == "left" else [])
        cuts = cuts.join(parts.select(F.col("key").alias(side), *names), side)
    each = cuts.groupBy("key", "size", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"), F.max("lang").alias("lang"), F.max("n").alias("n"))
    score = "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) DIV (CAST(c.l AS DECIMAL(19,0)) * CAST(c.r AS DECIMAL(19,0)))"
    scored = each.withColumn("c", F.expr(f"array_min(transform(cuts, c -> struct({score} AS score, c.k AS k, c.l AS l, c.r AS r)))")).select("lang", "key", "size", "a", "n", "c.score", "c.l", "c.r")
    order = [F.col("score").desc(), F.col("a").desc()]
    tied = F.rank().over(Window.partitionBy("lang").orderBy(*order))
    best = kept(scored.withColumn("place", tied).where(F.col("place") <= top).drop("place"), "phrases-best")
    ids = best.select("key", F.posexplode(F.expr("transform(sequence(0, size - 1), i -> substring(key, 4 * i + 1, 4))")).alias("at", "unit"))
    words_of = ids.join(known.select(unit.alias("unit"), "word"), "unit").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = best.join(words_of.select("key", F.array_join("w.word", " ").alias("phrase")), "key")
    last = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return named.withColumn("rank", last.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
