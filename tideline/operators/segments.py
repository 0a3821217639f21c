"""Segments of ordered streams: by change and length, dead-band changes within them, and run lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import squared_distance
from .ordered import Stream, by_block, previous

#: Longest run that one run-length operation holds.
RUN_MOST = 128


def _segmented(df: DataFrame, stream: Stream, most: Column | int, value: Column, cuts: Callable[[Column, Column], Column]) -> DataFrame:
    """df with _rank, _cut, `segment`, `place` and `is_start`, where a row cuts if cuts(its value, the value before) holds.

    A block knows its cuts but that of its first row, which needs the last value of the block before. So each block
    says where its first and last cut are and how many segments end between them; what a block begins in (the start of
    its segments' scene, and that segment's number) follows from the blocks before it. One step does it all. Ranks count from 1 here."""
    col = F.col

    def parts(length: Column, longest: Column = col("_most")) -> Column:
        return F.ceil(length / longest)

    def known(cut: Column) -> Column:
        return F.coalesce(cut, F.lit(False))

    local = [
        lambda w: {"_now": F.struct(value.alias("v")), "_most": (F.lit(most) if isinstance(most, int) else most).cast("long"), "_n": F.row_number().over(w.ordered).cast("long")},
        lambda w: {"_cut": (col("_n") > 1) & known(cuts(col("_now.v"), F.lag("_now").over(w.ordered)["v"]))},
        lambda w: {"_from": F.max(F.when(col("_cut"), col("_n"))).over(w.until), "_past": F.max(F.when(col("_cut"), col("_n"))).over(w.before)},
        lambda w: {"_ended": F.when(col("_cut"), parts(col("_n") - col("_past")))},
        lambda w: {"_ends": F.coalesce(F.sum("_ended").over(w.until), F.lit(0))},
    ]
    cut_at = F.when(col("_cut"), col("_n"))
    totals = {
        "_rows": F.count(F.lit(1)), "_longest": F.max("_most"), "_head": F.min_by("_now", "_n"), "_tail": F.max_by("_now", "_n"),
        "_first": F.min(cut_at), "_latest": F.max(cut_at), "_between": F.coalesce(F.sum("_ended"), F.lit(0)),
    }
    carried = [
        lambda w: {"_base": F.coalesce(F.sum("_rows").over(w.before), F.lit(0)), "_was": F.lag("_tail").over(w.ordered)},
        lambda w: {"_cuts": (col("_base") > 0) & known(cuts(col("_head.v"), col("_was.v")))},
        lambda w: {"_entry": F.when(col("_cuts") | (col("_base") == 0), col("_base") + 1)},
        lambda w: {"_old": F.last(F.coalesce(col("_base") + col("_latest"), col("_entry")), ignorenulls=True).over(w.before)},
        lambda w: {"_scene": F.coalesce("_entry", "_old"), "_closed": F.when(col("_entry").isNotNull() & col("_old").isNotNull(), parts(col("_base") + 1 - col("_old"), col("_longest"))).otherwise(0)},
        lambda w: {"_lead": F.when(col("_first").isNotNull(), parts(col("_base") + col("_first") - col("_scene"), col("_longest"))).otherwise(0)},
        lambda w: {"_number": F.coalesce(F.sum(col("_closed") + col("_lead") + col("_between")).over(w.before), F.lit(0)) + col("_closed")},
    ]
    inside = col("_from").isNotNull()
    into = F.when(inside, col("_n") - col("_from")).otherwise(col("_base") + col("_n") - col("_scene"))
    segment = col("_number") + F.when(inside, col("_lead") + col("_ends")).otherwise(0) + F.floor(into / col("_most"))
    out = {"_rank": col("_base") + col("_n") - 1, "_cut": F.when(col("_n") == 1, col("_cuts")).otherwise(col("_cut")), "segment": segment, "place": into % col("_most"), "is_start": into % col("_most") == 0}
    return by_block(df, stream, local, totals, carried, out)


def segmented(df: DataFrame, stream: Stream, cut: Column, most: Column | int) -> DataFrame:
    """df with `segment` (from 0 in each stream), `place` (from 0 in each segment) and `is_start`.

    A row where `cut` holds starts a segment, and so does one whose segment already has `most` rows (one number for a stream)."""
    return _segmented(df, stream, most, cut, lambda now, _: now).drop("_rank", "_cut")


def segmented_by_change(df: DataFrame, stream: Stream, value: Column, over: float, most: Column | int, name: str = "cut") -> DataFrame:
    """segmented() by changed_by() in one step, with the column of the latter."""
    return _segmented(df, stream, most, value, lambda now, was: F.abs(now - was) > over).withColumnRenamed("_cut", name).drop("_rank")


def changed_by(df: DataFrame, stream: Stream, value: Column, over: float, name: str = "cut") -> DataFrame:
    """df with whether the value differs from the row before by more than `over`; the first row of a stream doesn't."""
    got = previous(df.withColumn("_now", value), stream, "_was", F.col("_now"))
    return got.withColumn(name, F.coalesce(F.abs(F.col("_now") - F.col("_was")) > over, F.lit(False))).drop("_now", "_was")


def dead_band(df: DataFrame, segment_keys: list[str], place: str, value: str, skip: Column | float, sources: int = 1) -> DataFrame:
    """The rows of bounded segments with `sent`: whether their squared distance to the last row sent is above `skip`.

    The value is a number or a vector of numbers. A segment's first `sources` rows are always sent, and a row is
    compared with the last one sent of its place modulo `sources`. Sending depends on what was sent, so this is a fold;
    segments are bounded (see segmented), so a fold is one small array. Returns segment keys, place, value and `sent`."""
    is_vector = df.schema[value].dataType.simpleString().startswith("array")
    kind = "array<double>" if is_vector else "double"
    rows = df.groupBy(*segment_keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).cast("long").alias("place"), F.col(value).cast(kind).alias("value")))).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        lane = (x["place"] % sources).cast("int")
        last = F.get(acc["last"], lane)
        apart = squared_distance(x["value"], last) if is_vector else (x["value"] - last) * (x["value"] - last)
        send = last.isNull() | (apart > skip)
        kept = F.transform(acc["last"], lambda v, i: F.when((i == lane) & send, x["value"]).otherwise(v))
        return F.struct(kept.alias("last"), F.array_append(acc["out"], F.struct(x["place"].alias("place"), x["value"].alias("value"), send.alias("sent"))).alias("out"))

    start = F.struct(F.array_repeat(F.lit(None).cast(kind), sources).alias("last"), F.array().cast(f"array<struct<place:bigint,value:{kind},sent:boolean>>").alias("out"))
    folded = rows.select(*segment_keys, F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x"))
    return folded.select(*segment_keys, F.col("x.place").alias(place), F.col("x.value").alias(value), "x.sent")


def run_lengths(df: DataFrame, stream: Stream, value: Column, most: int = RUN_MOST) -> DataFrame:
    """A row for each run of equal values, cut at `most`: keys, start (row number), n and value."""
    cut = _segmented(df.withColumn("_value", value), stream, most, F.col("_value"), lambda now, was: ~now.eqNullSafe(was))
    return cut.groupBy(*stream.keys, "segment").agg(F.min("_rank").alias("start"), F.count(F.lit(1)).alias("n"), F.first("_value").alias("value")).drop("segment")


def expand_runs(runs: DataFrame, start: str = "start", n: str = "n") -> DataFrame:
    """A row for each place of each run: the inverse of run_lengths."""
    return runs.withColumn("place", F.explode(F.sequence(F.col(start), F.col(start) + F.col(n) - 1))).drop(start, n)
