"""As-of and point-in-interval lookups, on running values: no range join and no product of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Running, Stream, running


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, right_id: str, value: Column, block: Column, *, forward: bool = False, fill: bool = False, name: str = "value") -> DataFrame:
    """left with the value of the latest right row of its key at or before it (forward: the earliest at or after it).

    block: of a column `at`, which holds either side's place. Of right rows at one place the one with the largest
    right_id counts (forward: the smallest). fill: a left row before all right rows takes the first one's value."""
    lefts = left.select(F.struct(*left.columns).alias("_left"), *[F.col(k) for k in keys], F.col(left_at).alias("at"), F.lit(0 if forward else 1).alias("_side"), F.lit(None).cast("long").alias("_id"))
    picked = right.select(*[F.col(k) for k in keys], F.col(right_at).alias("at"), F.lit(1 if forward else 0).alias("_side"), F.col(right_id).cast("long").alias("_id"), F.struct(value.alias("v")).alias("_right"))
    rows = lefts.unionByName(picked, allowMissingColumns=True)
    kinds = {"_hit": ("last", F.col("_right"))}
    got = running(rows, Stream(keys, ["at", "_side", "_id"], block), kinds, reverse=forward).where("_left is not null")
    if not fill:
        return got.select("_left.*", F.col("_hit.v").alias(name))
    first = picked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by("_right", F.struct("at", "_id")).alias("_first"))
    on = None
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return got.join(first, on, "left").select("_left.*", F.coalesce("_hit", "_first")["v"].alias(name))


def in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, interval_id: str, value: Column, block: Column, name: str = "value") -> DataFrame:
    """points with the value of the interval [start, end) of their key that holds them; intervals of a key don't overlap."""
    got = asof(points, intervals, keys, at, start, interval_id, F.struct(F.col(end).alias("end"), value.alias("v")), block, name="_interval")
    return got.withColumn(name, F.when(F.col(at) < F.col("_interval.end"), F.col("_interval.v"))).drop("_interval")


def segment_bounds(df: DataFrame, stream: Stream, place: str, is_start: Column) -> DataFrame:
    """df with the latest segment start at or before each row (else 0) and the earliest at or after it (else null)."""
    start = F.when(is_start, F.col(place))
    both = running(df, stream, {"start_before": ("max", start), "start_after": Running("min", start, reverse=True)})
    return both.withColumn("start_before", F.coalesce("start_before", F.lit(0)))
