"""Resampling and ADPCM for sampled streams, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.sources.stored import stored

from .ordered import Stream, previous

#: Block numbers in a span, which is coded at once; rounds in which spans are coded again; samples that suggest a state;
#: runs of blocks coded in one numpy loop, and from how many on; spans whose states are compared by one task.
SPAN, ROUNDS, TAIL, RUNS_AT_ONCE, MANY_RUNS, SPANS_TOGETHER = 16, 8, 256, 256, 16, 4096
#: Taps of the low-pass filter, and samples that a place needs before and after it.
TAPS = 65
BEFORE, AFTER = TAPS // 2, TAPS // 2 + 1
# Step sizes and index changes of IMA ADPCM.
STEP_SIZES = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630,
    9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
INDEX_CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


def low_pass(in_rate: float, out_rate: float) -> np.ndarray:
    """A windowed-sinc filter that keeps what the lower rate can hold."""
    cut = min(0.45, 0.45 * out_rate / in_rate)
    x = np.arange(TAPS) - TAPS // 2
    taps = 2 * cut * np.sinc(2 * cut * x) * np.hanning(TAPS)
    return taps / taps.sum()


def resampled(blocks: DataFrame, key: str, block: str, start: str, samples: str, in_rate: float, out_rate: float) -> DataFrame:
    """(key, first, out array<smallint>): the stream of each key at another rate; `first` is the number of out's first sample.

    blocks: consecutive runs of float samples, each of BEFORE + AFTER samples at least (but the last), with the number
    of their first one. A place needs few samples beyond its block, so each block sends only its edges to its
    neighbours and every block is computed apart; the result doesn't depend on how the stream was cut."""
    edge = BEFORE + AFTER
    size = F.size(samples)
    own = F.struct(F.col(block).alias("to"), F.lit(1).alias("part"), F.col(start).alias("at"), F.col(samples).alias("x"))
    head = F.struct((F.col(block) - 1).alias("to"), F.lit(2).alias("part"), F.col(start).alias("at"), F.slice(samples, 1, edge).alias("x"))
    tail = F.struct((F.col(block) + 1).alias("to"), F.lit(0).alias("part"), (F.col(start) + F.greatest(size - edge, F.lit(0))).alias("at"), F.slice(samples, F.greatest(size - edge, F.lit(0)) + 1, edge).alias("x"))
    sent = blocks.select(F.col(key).alias("key"), F.explode(F.array(own, head, tail)).alias("p")).select("key", "p.*")
    piece = [F.max(F.when(F.col("part") == part, F.struct("at", "x"))).alias(name) for part, name in enumerate(("tail", "own", "head"))]
    met = sent.groupBy("key", "to").agg(*piece).where("own is not null")  # else a neighbour beyond the stream's ends
    taps, step = low_pass(in_rate, out_rate)[::-1].copy(), in_rate / out_rate

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, outs = [], []
            parts = [(batch[name].field("at").to_numpy(zero_copy_only=False), batch[name].field("x"), batch[name].is_valid().to_numpy(zero_copy_only=False)) for name in ("own", "tail", "head")]
            for i in range(len(batch)):
                at, n = int(parts[0][0][i]), len(parts[0][1][i])
                x = np.zeros(n + 2 * edge)
                for starts, values, valid in parts:
                    if valid[i]:
                        piece = np.asarray(values[i].values, np.float64)
                        begin = int(starts[i]) - at + edge
                        x[begin : begin + len(piece)] = piece
                # places p with their sample floor(p * step) in this block
                first, last = int(np.ceil(at / step)), int(np.ceil((at + n) / step))
                place = np.arange(first, last) * step
                left = np.floor(place).astype(np.int64)
                filtered = np.convolve(x, taps, "valid")
                base = left - at + edge - BEFORE
                value = filtered[base] * (1 - (place - left)) + filtered[base + 1] * (place - left)
                firsts.append(first)
                outs.append(np.clip(np.floor(value * 32767 + 0.5), -32768, 32767).astype(np.int16))
            yield pa.record_batch([batch["key"], pa.array(firsts, pa.int64()), pa.array(outs, pa.list_(pa.int16()))], ["key", "first", "out"])

    kind = blocks.schema[key].dataType.simpleString()
    return met.mapInArrow(work, f"key {kind}, first long, out array<smallint>").withColumnRenamed("key", key)


def _change(step: int, code: int) -> int:
    size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
    return -size if code & 8 else size


def encode_block(samples: np.ndarray, value: int, index: int) -> tuple[bytes, int, int]:
    """Codes of a block (low half first), and the state after it."""
    codes = np.zeros(len(samples) + len(samples) % 2, np.uint8)
    for i, s in enumerate(samples.tolist()):
        step, rest, code = STEP_SIZES[index], s - value, 0
        if rest < 0:
            code, rest = 8, -rest
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            if rest >= part:
                code, rest = code | bit, rest - part
        value = min(max(value + _change(step, code), -32768), 32767)
        index = min(max(index + INDEX_CHANGES[code & 7], 0), len(STEP_SIZES) - 1)
        codes[i] = code
    return (codes[::2] | codes[1::2] << 4).tobytes(), value, index


def encode_runs(runs: list[list[np.ndarray]], value: np.ndarray, index: np.ndarray) -> tuple[list[list[tuple[int, int, bytes]]], np.ndarray, np.ndarray]:
    """Of many runs of blocks, each with its own state before it: (pred, idx, codes) of every block; and the states after the runs.

    Few runs are coded sample by sample, many by numpy across the runs; the codes are the same."""
    value, index = value.astype(np.int64), index.astype(np.int64)
    if len(runs) < MANY_RUNS:
        out = []
        for i, blocks in enumerate(runs):
            coded = []
            for x in blocks:
                data, after_value, after_index = encode_block(x, int(value[i]), int(index[i]))
                coded.append((int(value[i]), int(index[i]), data))
                value[i], index[i] = after_value, after_index
            out.append(coded)
        return out, value, index
    lengths = np.array([sum(map(len, blocks)) for blocks in runs], np.int64)
    order = np.argsort(-lengths, kind="stable")  # so that the runs which still go on are always the first columns
    falling, wide = -lengths[order], int(lengths.max())
    x, codes = np.zeros((wide, len(runs)), np.int32), np.zeros((wide, len(runs)), np.uint8)
    starts: dict[int, list[int]] = {}
    for column, i in enumerate(order.tolist()):
        at = 0
        for part in runs[i]:
            x[at : at + len(part), column] = part
            starts.setdefault(at, []).append(column)
            at += len(part)
    states: list[list[tuple[int, int]]] = [[] for _ in runs]
    value, index = value[order], index[order]
    steps = np.array(STEP_SIZES, np.int64)
    for at in range(wide + 1):
        for column in starts.get(at, ()):
            states[column].append((int(value[column]), int(index[column])))
        if at == wide:
            break
        m = int(np.searchsorted(falling, -at, "left"))
        step, rest = steps[index[:m]], x[at, :m] - value[:m]
        down, rest = rest < 0, np.abs(rest)
        code, change = np.zeros(m, np.int64), step >> 3
        for bit in (4, 2, 1):
            takes = rest >= step
            part = np.where(takes, step, 0)
            code, rest, change, step = code + bit * takes, rest - part, change + part, step >> 1
        value[:m] = np.clip(value[:m] + np.where(down, -change, change), -32768, 32767)
        index[:m] = np.clip(index[:m] + np.array(INDEX_CHANGES)[code], 0, len(steps) - 1)
        codes[at, :m] = code + 8 * down
    out: list[list[tuple[int, int, bytes]]] = [[] for _ in runs]
    for column, i in enumerate(order.tolist()):
        at = 0
        for part, (pred, idx) in zip(runs[i], states[column], strict=True):
            c = codes[at : at + len(part), column]
            c = np.append(c, np.uint8(0)) if len(c) % 2 else c
            out[i].append((pred, idx, (c[::2] | c[1::2] << 4).tobytes()))
            at += len(part)
    back = np.argsort(order)
    return out, value[back], index[back]


def guessed(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The state after each tail of samples, coded from its first sample and a step of the size of its mean change."""
    value = np.array([t[0] if len(t) else 0 for t in tails], np.int64)
    index = np.array([np.searchsorted(STEP_SIZES[:-1], np.abs(np.diff(t)).mean()) if len(t) > 1 else 0 for t in tails], np.int64)
    return encode_runs([[t] for t in tails], value, index)[1:]


SPAN_STATE = "key {kind}, span long, pred int, idx int, after_pred int, after_idx int, coded array<struct<block:long,pred:int,idx:int,data:binary>>"


def _parts(batch: pa.RecordBatch, row: int) -> tuple[list[int | None], list[np.ndarray]]:
    parts = batch["parts"][row].values
    return parts.field("block").to_pylist(), [np.asarray(x.values, np.int64) for x in parts.field("x")]


def _coded(found: list[tuple], batch: pa.RecordBatch, rows: slice, schema: pa.DataType) -> pa.RecordBatch:
    """A record batch of (pred, idx, after_pred, after_idx, coded) beside the batch's keys and spans."""
    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int32()] * 4 + [schema], strict=True)]
    return pa.record_batch([batch["key"][rows], batch["span"][rows], *columns], ["key", "span", "pred", "idx", "after_pred", "after_idx", "coded"])


CODED = pa.list_(pa.struct([("block", pa.int64()), ("pred", pa.int32()), ("idx", pa.int32()), ("data", pa.binary())]))


def _encoded_spans(spans: DataFrame, kind: str) -> DataFrame:
    """Spans coded from their stated start, or from the one that their tail suggests."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), RUNS_AT_ONCE):
                rows = range(first, min(first + RUNS_AT_ONCE, len(batch)))
                blocks, runs = zip(*(_parts(batch, r) for r in rows), strict=True)
                value, index = guessed([np.asarray(batch["tail"][r].values if batch["tail"][r].is_valid else [], np.int64) for r in rows])
                stated = [(batch["start"][r]["pred"].as_py(), batch["start"][r]["idx"].as_py()) if batch["start"][r].is_valid else None for r in rows]
                value = np.array([v if s is None else s[0] for v, s in zip(value.tolist(), stated, strict=True)], np.int64)
                index = np.array([v if s is None else s[1] for v, s in zip(index.tolist(), stated, strict=True)], np.int64)
                coded, after_value, after_index = encode_runs(list(runs), value, index)
                lists = [[{"block": b, "pred": p, "idx": i, "data": d} for b, (p, i, d) in zip(bs, cs, strict=True)] for bs, cs in zip(blocks, coded, strict=True)]
                found = list(zip(value.tolist(), index.tolist(), after_value.tolist(), after_index.tolist(), lists, strict=True))
                yield _coded(found, batch, slice(rows.start, rows.stop), CODED)

    return spans.select("key", "span", "parts", "tail", "start").mapInArrow(work, SPAN_STATE.format(kind=kind))


def _encoded_in_turn(spans: DataFrame, kind: str) -> DataFrame:
    """All spans of each key one after the other, from the stated state before its first one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value, index = object(), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            for r in range(len(batch)):
                key = batch["key"][r].as_py()
                if key != now:
                    now, value, index = key, np.zeros(1, np.int64), np.zeros(1, np.int64)
                    if batch["start"][r].is_valid:
                        value[0], index[0] = batch["start"][r]["pred"].as_py(), batch["start"][r]["idx"].as_py()
                blocks, run = _parts(batch, r)
                before = (int(value[0]), int(index[0]))
                (coded,), value, index = encode_runs([run], value, index)
                listed = [{"block": b, "pred": p, "idx": i, "data": d} for b, (p, i, d) in zip(blocks, coded, strict=True)]
                yield _coded([(*before, int(value[0]), int(index[0]), listed)], batch, slice(r, r + 1), CODED)

    dealt = spans.select("key", "span", "parts", "start").repartition("key").sortWithinPartitions("key", "span")
    return dealt.mapInArrow(work, SPAN_STATE.format(kind=kind))


def adpcm_encoded(blocks: DataFrame, key: str, block: str, samples: str, span: int = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """(key, block, pred, idx, data) of each block of int16 samples; pred and idx are the state before the block.

    The state runs through all of a key's blocks, yet a clip is many tasks: spans of `span` block numbers are coded at
    once, each from a guess that the end of the span before suggests. Spans whose guess wasn't the state in which the
    span before ended are coded again from that state, until every span starts where the one before ended; then the
    codes are those of coding in turn. Coders with different states mostly fall into step within a span, so most spans
    are coded twice and few more often, all at once. What still differs after `rounds` rounds is coded in turn, from the first such span of its key.

    A null or empty block has no codes, a null sample is 0; a null block number comes first, null keys are a key, and
    blocks of one number are taken in order of their samples. An empty table gives an empty result."""
    kind = blocks.schema[key].dataType.simpleString()
    x = F.transform(F.coalesce(F.col(samples), F.array().cast("array<smallint>")), lambda v: F.coalesce(v.cast("int"), F.lit(0)))
    rows = blocks.select(F.col(key).alias("key"), F.col(block).cast("long").alias("block"), x.alias("x"))
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("block") / span), F.lit(-(1 << 62))))
    spans = stored(rows.groupBy("key", "span").agg(F.array_sort(F.collect_list(F.struct("block", "x"))).alias("parts")), "adpcm-spans")
    stream = Stream(["key"], ["span"], f"floor(span / {SPANS_TOGETHER})")
    last = F.element_at("parts", -1)["x"]
    tail = F.slice(last, F.greatest(F.size(last) - TAIL + 1, F.lit(1)), TAIL)
    nothing = F.lit(None).cast("struct<pred:int,idx:int>")
    tails = previous(spans.select("key", "span", tail.alias("own")), stream, "tail", F.col("own")).select("key", "span", "tail")

    def at(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
        named = other.withColumnsRenamed({"key": "_key", "span": "_span"})
        return df.join(named, F.col("key").eqNullSafe(F.col("_key")) & (F.col("span") == F.col("_span")), how).drop("_key", "_span")

    def wrong(now: DataFrame) -> DataFrame:
        due = previous(now, stream, "before", F.struct(F.col("after_pred").alias("pred"), F.col("after_idx").alias("idx")))
        start = F.coalesce("before", F.struct(F.lit(0).alias("pred"), F.lit(0).alias("idx")))
        return stored(due.withColumn("start", start).where((F.col("start.pred") != F.col("pred")) | (F.col("start.idx") != F.col("idx"))).select("key", "span", "start"), "adpcm-wrong")

    state = ["key", "span", "pred", "idx", "after_pred", "after_idx"]
    coded = stored(_encoded_spans(at(spans, tails).withColumn("start", nothing), kind), "adpcm-coded")
    done, now = [coded], coded.select(*state)
    differ = wrong(now)
    for _ in range(rounds):
        if differ.isEmpty():
            break
        again = stored(_encoded_spans(at(spans, differ).withColumn("tail", F.lit(None).cast("array<int>")), kind), "adpcm-coded")
        done = [at(d, differ, "left_anti") for d in done] + [again]
        now = stored(at(now, differ, "left_anti").unionByName(again.select(*state)), "adpcm-states")
        differ = wrong(now)
    if not differ.isEmpty():
        first = differ.groupBy("key").agg(F.min("span").alias("_from"), F.min_by("start", "span").alias("_start")).withColumnRenamed("key", "_key")
        late = F.col("key").eqNullSafe(F.col("_key")) & (F.col("span") >= F.col("_from"))
        rest = spans.join(first, late).withColumn("start", F.when(F.col("span") == F.col("_from"), F.col("_start")))
        done = [d.join(first, late, "left_anti") for d in done] + [stored(_encoded_in_turn(rest, kind), "adpcm-coded")]
    out = done[0].select("key", F.explode("coded").alias("c"))
    for d in done[1:]:
        out = out.unionByName(d.select("key", F.explode("coded").alias("c")))
    return out.select(F.col("key").alias(key), F.col("c.block").alias(block), "c.pred", "c.idx", "c.data")


def adpcm_decoded(blocks: DataFrame, key: str, block: str, pred: str = "pred", idx: str = "idx", data: str = "data") -> DataFrame:
    """(key, block, samples array<smallint>): every block on its own, as it carries its state; numpy across the blocks of a batch."""
    steps = np.array(STEP_SIZES, np.int64)
    by = np.array([_change(s, c) for s in STEP_SIZES for c in range(16)], np.int64).reshape(-1, 16)
    to = np.array([min(max(i + INDEX_CHANGES[c & 7], 0), len(steps) - 1) for i in range(len(steps)) for c in range(16)]).reshape(-1, 16)
    kind = blocks.schema[key].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            raw = [np.frombuffer(d, np.uint8) for d in df["data"]]
            sizes = np.array([2 * len(r) for r in raw], np.int64)
            wide = int(sizes.max()) if len(sizes) else 0
            codes = np.zeros((len(raw), wide), np.int64)
            for row, r in zip(codes, raw, strict=True):
                row[: 2 * len(r) : 2], row[1 : 2 * len(r) : 2] = r & 15, r >> 4
            value, index = df["pred"].to_numpy(np.int64), df["idx"].to_numpy(np.int64)
            out = np.zeros((wide, len(raw)), np.int16)
            for i in range(wide):
                c = codes[:, i]
                value = np.clip(value + by[index, c], -32768, 32767)
                index = to[index, c]
                out[i] = value
            yield pd.DataFrame({"key": df["key"], "block": df["block"], "samples": [out[:n, i] for i, n in enumerate(sizes)]})

    rows = blocks.select(F.col(key).alias("key"), F.col(block).cast("long").alias("block"), F.col(pred).alias("pred"), F.col(idx).alias("idx"), F.col(data).alias("data"))
    return rows.mapInPandas(work, f"key {kind}, block long, samples array<smallint>").withColumnsRenamed({"key": key, "block": block})
