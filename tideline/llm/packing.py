"""Best-fit packing of token sequences by a configuration linear program.

The pieces' length histogram (as many numbers as a sequence has tokens) is all the driver sees. A configuration is a
multiset of lengths that fits a sequence; the linear program asks for the least total weight of configurations that
covers every length's count. Multiplicative weights price the lengths: in each of ROUNDS rounds a length's price is its
size times the exponential of how far its coverage lags behind the rounds gone, and a knapsack dynamic program over the
capacity finds, for every length that lags, the dearest configuration that holds it, whose weight grows by what is
lacking. Prices over the dearest configuration's price are a solution of the dual program, so every round also bounds
the number of sequences from below. The weights are then scaled so that no length is covered more than once, and rounded
down to whole copies, the fractions of the configurations of one longest length being carried on together. The pieces
that rounding leaves are placed best-fit decreasing, as counts; or the program is solved for them once more, if that takes fewer
sequences. Then every piece, numbered within its length by counts of hash buckets, looks up its place in the table of
configurations, whose size depends on rounds and lengths but not on the number of pieces; no task holds a whole length.

Null texts count as empty. Equal documents are separate pieces. A doc_id that repeats gets separate places in no
particular order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, runs, slices
from .tokens import ROOMY, encoder

Config = tuple[int, ...]
#: Rounds of the multiplicative weights, their step, how far below the dearest configuration's value one may be, and how
#: often the program is solved at most.
ROUNDS, STEP, SLACK, SOLUTIONS = 48, 0.1, 0.01, 2


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", room: tuple[int, int] = ROOMY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than the capacity are cut, a shorter rest comes first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, room[1])
        for batch in batches:
            for b in slices(batch, limit=room[0]):
                flat, counts = enc.encode(b["text"])
                flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                no = runs(np.zeros(len(n), np.int64), n)
                ends = (counts - (n - 1) * capacity)[doc] + no * capacity
                starts = np.where(no == 0, 0, ends - capacity)
                at = (np.cumsum(counts) - counts)[doc]
                raw = memoryview(flat.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((at + starts).tolist(), (at + ends).tolist(), strict=True)]
                yield pa.record_batch([b["doc_id"].take(pa.array(doc)), pa.array(no, pa.int32()), pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for every capacity, and the length taken last (0: none fits)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if k := fitting[c]:
            total = best[c - lengths[:k]] + values[:k]
            i = int(total.argmax())
            best[c], last[c] = total[i], lengths[i]
    return best, last


def program(histogram: dict[int, int], capacity: int) -> tuple[dict[Config, float], float]:
    """Weights of configurations that together cover no length more than its count, and a lower bound of the program."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[k] for k in lengths.tolist()], np.float64)
    place = {k: i for i, k in enumerate(lengths.tolist())}
    covered, weight, bound = np.zeros(len(lengths)), defaultdict(float), 0.0
    members: dict[Config, tuple[np.ndarray, np.ndarray]] = {}
    prices = lengths / capacity
    for done in range(1, ROUNDS + 1):
        best, last = price(prices, lengths, capacity)
        bound = max(bound, float(counts @ prices) / best[capacity])
        for i in range(len(lengths) - 1, -1, -1):
            lack = counts[i] * done / ROUNDS - covered[i]
            room = capacity - int(lengths[i])
            if lack <= 1e-9 or prices[i] + best[room] < (1 - SLACK) * best[capacity]:
                continue
            held = [int(lengths[i])]
            while last[room]:
                held.append(int(last[room]))
                room -= held[-1]
            config = tuple(sorted(held, reverse=True))
            if config not in members:
                members[config] = np.unique([place[k] for k in config], return_counts=True)
            at, times = members[config]
            more = lack / times[np.searchsorted(at, i)]
            weight[config] += more
            covered[at] += more * times
        prices = lengths / capacity * np.exp(STEP * (done / ROUNDS - covered / counts))
    fit = np.minimum(1, counts / np.maximum(covered, 1e-12))
    return {c: x * float(fit[members[c][0]].min()) for c, x in weight.items()}, bound


def rounded(weights: dict[Config, float], histogram: dict[int, int]) -> tuple[dict[Config, int], dict[int, int]]:
    """Whole copies of the configurations, and the pieces they leave."""
    left, carried, copies = dict(histogram), defaultdict(float), {}
    for config in sorted(weights, reverse=True):
        times = Counter(config)
        carried[config[0]] += weights[config]
        n = min(int(carried[config[0]] + 1e-9), *(left[k] // t for k, t in times.items()))
        if n:
            carried[config[0]] -= n
            copies[config] = n
            for k, t in times.items():
                left[k] -= n * t
    return copies, {k: n for k, n in left.items() if n}


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Config, int]], int]:
    """Configurations (lengths in falling order) and how often each is used, which together hold the histogram exactly; and a number of sequences that no packing is below."""
    left = {k: n for k, n in histogram.items() if n and k < capacity}
    whole = histogram.get(capacity, 0)
    found, packings, least = Counter({(capacity,): whole} if whole else {}), [], 0
    for i in range(SOLUTIONS):
        weights, bound = program(left, capacity) if left else ({}, 0.0)
        copies, left = rounded(weights, left)
        found.update(copies)
        least = math.ceil(bound - 1e-6) if i == 0 else least
        packings.append(found + Counter(dict(best_fit(left, capacity))))
    return sorted(min(packings, key=lambda p: p.total()).items()), least + whole


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best-fit decreasing on counts: equal sequences stay one entry with a count."""
    by_room: dict[int, dict[Config, int]] = defaultdict(dict)
    rooms = np.zeros(capacity + 1, bool)
    for k in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        n = histogram[k]
        while n:
            fit = np.flatnonzero(rooms[k:])
            if not len(fit):
                per = min(capacity // k, n)
                whole, over = divmod(n, per)
                for copies, times in ((per, whole), (over, 1)):
                    if copies and times:
                        group = by_room[capacity - copies * k]
                        group[(k,) * copies] = group.get((k,) * copies, 0) + times
                        rooms[capacity - copies * k] = True
                break
            room = k + int(fit[0])
            config, have = next(iter(by_room[room].items()))
            take = min(n, have)
            del by_room[room][config]
            if have > take:
                by_room[room][config] = have - take
            rooms[room] = bool(by_room[room])
            new = (*config, k)
            by_room[room - k][new] = by_room[room - k].get(new, 0) + take
            rooms[room - k] = True
            n -= take
    return [(c, n) for group in by_room.values() for c, n in group.items()]


def places(configs: list[tuple[Config, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slot runs, sorted by (length, first rank): the key length << 40 | rank, and copies, first sequence and offset."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for config, n in configs:
        offset = 0
        for k in sorted(set(config), reverse=True):
            copies = config.count(k)
            rows.append((k << 40 | rank[k], copies, sequence, offset))
            rank[k] += n * copies
            offset += k * copies
        sequence += n
    table = np.array(sorted(rows) or np.zeros((0, 4)), np.int64)
    return table[:, 0], table[:, 1:]


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, room: tuple[int, int] = ROOMY) -> DataFrame:
    """Every piece with its sequence_id and offset; room: see tokens."""
    spark = docs.sparkSession
    buckets = max(64, 2 * docs.rdd.getNumPartitions())
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    rows = kept(pieces(docs, path, end_id, capacity, room=room).withColumn("bucket", bucket), "pieces")
    counts = kept(rows.groupBy("length", "bucket").count(), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(places(solve(histogram, capacity)[0]))  # bounded: about ROUNDS * SOLUTIONS configurations a length at most
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("length", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "length", "ids_crc32"))
    ranked = rows.withColumn("own", own).join(first, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots = table.value
        for b in batches:
            length, rank = np.asarray(b["length"]), np.asarray(b["rank"])
            key = length << 40 | rank
            at = np.searchsorted(keys, key, "right") - 1
            copies, sequence, offset = slots[at].T
            instance, copy = np.divmod(key - keys[at], copies)
            yield pa.record_batch([*b.columns[:5], pa.array(sequence + instance), pa.array(offset + copy * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
