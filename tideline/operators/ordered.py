"""Running values over ordered streams, computed block by block so that a hot key is never one task's work.

A stream is the rows of a key in a stated order. The caller names a `block`: an expression that never falls along the
order (a day of the timestamp, a range of ordinals). A running value is then the value within the row's own (key,
block) combined with what all earlier blocks of the key give; only one small row per (key, block) meets in the second
step. All further operators on ordered streams are compositions of this one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stream:
    """How a table is a set of ordered streams: key columns, order columns (a total order) and the block of a row.

    The block is a column or an SQL expression; the latter can be stated before there is a session."""

    keys: list[str]
    order: list[str]
    block: Column | str


#: Kinds of running values: the aggregate, and how an earlier value and a later one combine.
KINDS = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (None, lambda a, b: F.coalesce(b, a)),
}
#: A stage of columns; each is given the windows that it may use.
Stage = Callable[["Places"], dict[str, Column]]


class Places:
    """The windows of a step: the rows of a block, or the blocks of a key, in order; `turned` are those of the other way."""

    def __init__(self, by: list[str], order: list[str], *, reverse: bool, both: bool = True) -> None:
        way = F.desc_nulls_last if reverse else F.asc_nulls_first
        self.ordered = Window.partitionBy(*by).orderBy(*[way(c) for c in order])
        if both:
            self.turned = Places(by, order, reverse=not reverse, both=False)
        self.until = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.ordered.rowsBetween(Window.unboundedPreceding, -1)


def by_block(df: DataFrame, stream: Stream, local: list[Stage], totals: dict[str, Column], carried: list[Stage], out: dict[str, Column], *, reverse: bool = False) -> DataFrame:
    """df with the columns `out`, from what is known within blocks and what earlier blocks of the key carry into them.

    local: stages of columns over the rows of a block. totals: aggregates of a block's rows. carried: stages of columns
    over the totals of a key's blocks. `out` may use all of these. Rows are shuffled once, whatever the stages are."""
    block = F.expr(stream.block) if isinstance(stream.block, str) else stream.block
    # one column for key and block, never null and equal where nulls meet: windows, block totals and join are dealt by it alike
    at = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(stream.keys)], block.alias("block"))
    inside = Places(["_at"], stream.order, reverse=reverse)
    blocks = Places([f"_at.k{i}" for i in range(len(stream.keys))], ["_at.block"], reverse=reverse)
    rows = df.withColumn("_at", at)
    for stage in local:
        rows = rows.withColumns(stage(inside)) if stage(inside) else rows
    # the totals read whole rows of the same windows, so that Spark shuffles (and scans) the rows once for both
    row = F.first(F.struct(*rows.columns)).alias("_row")
    carry = rows.groupBy("_at").agg(row, *[c.alias(n) for n, c in totals.items()]).where("_row is not null").drop("_row")
    for stage in carried:
        carry = carry.withColumns(stage(blocks)) if stage(blocks) else carry
    return rows.join(carry, "_at").select(*[c for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


@dataclass(frozen=True)
class Running:
    """A running value: its kind, what it is of, whether the row itself counts, and whether later rows count instead of earlier ones.

    Kinds are sum, max, min and last (the last value that isn't null); all skip nulls and are null where nothing came
    before. A peak is of a pair (step, extra): the largest of the rows' extra plus the sum of the steps up to the row;
    a null step is 0, a row with a null extra has no part in the largest."""

    kind: str
    of: Column | tuple[Column, Column]
    own: bool = True
    reverse: bool = False


def running(df: DataFrame, stream: Stream, values: dict[str, Running | tuple[str, Column]], *, with_own: bool = True, reverse: bool = False) -> DataFrame:
    """df with a column for each of `values` over the rows before a row. Null keys are a key.

    (kind, expression) stands for a Running with this call's with_own and reverse. All values come from one step."""
    asked = {n: v if isinstance(v, Running) else Running(*v, with_own, reverse) for n, v in values.items()}
    names = {n: f"_{i}" for i, n in enumerate(asked)}
    turned = {n for n, v in asked.items() if v.reverse}

    def over(v: Running, col: str, windows: Places, *, own: bool) -> Column:
        window = windows.until if own else windows.before
        return F.last(col, ignorenulls=True).over(window) if v.kind == "last" else KINDS["max" if v.kind == "peak" else v.kind][0](col).over(window)

    def stages(way: bool) -> tuple[list[Stage], dict[str, Column], list[Stage], dict[str, Column]]:
        """The stages of the values that run one way."""
        mine = {names[n]: v for n, v in asked.items() if v.reverse == way}
        peaks = {n: v for n, v in mine.items() if v.kind == "peak"}
        place = F.struct(*stream.order)

        def total(n: str, v: Running) -> Column:
            if v.kind != "last":
                return KINDS["max" if v.kind == "peak" else v.kind][0](f"_v{n}")
            return (F.min_by if way else F.max_by)(f"_v{n}", F.when(F.col(f"_v{n}").isNotNull(), place))

        local = [
            lambda w: {f"_v{n}": v.of for n, v in mine.items() if n not in peaks} | {f"_s{n}": F.sum(F.coalesce(v.of[0], F.lit(0))).over(w.until) for n, v in peaks.items()},
            lambda w: {f"_v{n}": F.col(f"_s{n}") + v.of[1] for n, v in peaks.items()},
            lambda w: {f"_in{n}": over(v, f"_v{n}", w, own=v.own) for n, v in mine.items()},
        ]
        totals = {f"_t{n}": total(n, v) for n, v in mine.items()} | {f"_d{n}": F.sum(F.coalesce(v.of[0], F.lit(0))) for n, v in peaks.items()}
        carried = [
            lambda w: {f"_e{n}": F.coalesce(F.sum(f"_d{n}").over(w.before), F.lit(0)) for n in peaks},
            lambda w: {f"_t{n}": F.col(f"_e{n}") + F.col(f"_t{n}") for n in peaks},
            lambda w: {f"_b{n}": over(v, f"_t{n}", w, own=False) for n, v in mine.items()},
        ]
        out = {n: F.greatest(F.col(f"_b{n}"), F.col(f"_e{n}") + F.col(f"_in{n}")) if n in peaks else KINDS[v.kind][1](F.col(f"_b{n}"), F.col(f"_in{n}")) for n, v in mine.items()}
        return local, totals, carried, out

    def facing(stage: Stage, *, reverse: bool) -> Stage:
        return lambda w: stage(w.turned if reverse else w)

    parts = {way: stages(way) for way in (False, True) if any(v.reverse == way for v in asked.values())}
    local = [facing(s, reverse=way and len(parts) > 1) for way, p in parts.items() for s in p[0]]
    carried = [facing(s, reverse=way and len(parts) > 1) for way, p in parts.items() for s in p[2]]
    totals = {n: c for p in parts.values() for n, c in p[1].items()}
    out = {n: c for p in parts.values() for n, c in p[3].items()}
    return by_block(df, stream, local, totals, carried, {n: out[names[n]] for n in asked}, reverse=len(turned) == len(asked))


def previous(df: DataFrame, stream: Stream, name: str, value: Column, *, reverse: bool = False) -> DataFrame:
    """df with the value of the row before (reverse: after); null at the edge of a stream. The value may be null."""
    got = running(df, stream, {"_row": ("last", F.struct(value.alias("v")))}, with_own=False, reverse=reverse)
    return got.withColumn(name, F.col("_row.v")).drop("_row")


def ranked(df: DataFrame, stream: Stream, name: str = "rank") -> DataFrame:
    """df with each row's number in its stream, from 0."""
    return running(df, stream, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def offsets(df: DataFrame, stream: Stream, size: Column, name: str = "offset") -> DataFrame:
    """df with the sum of the sizes before a row: where its bytes begin in a section."""
    return running(df, stream, {name: ("sum", size)}, with_own=False).withColumn(name, F.coalesce(name, F.lit(0)))


def within_budget(df: DataFrame, stream: Stream, cost: Column, limit: Column | int, name: str = "fits") -> DataFrame:
    """df with the running cost and whether all rows up to this one fit; after the first that doesn't, none does.

    A null cost is nothing, a null limit none."""
    limited = F.lit(limit) if isinstance(limit, int) else limit
    got = running(df, stream, {"running_cost": ("sum", cost), "_over": Running("peak", (cost, -limited))})
    return got.withColumn(name, ~F.coalesce(F.col("_over") > 0, F.lit(False))).drop("_over")


def gap_filled(df: DataFrame, stream: Stream, start: str, length: str) -> DataFrame:
    """df with the silence to insert before a chunk and the place where the chunk is written.

    A chunk that starts after what is written so far is moved there by silence; an overlap is appended, not trimmed.
    The written end is the largest start less the lengths before it, plus the lengths so far."""
    size, lead = F.col(length), (-F.col(length), F.col(start) + F.col(length))
    got = running(df, stream, {"_sum": ("sum", size), "_lead": Running("peak", lead), "_sum_before": Running("sum", size, own=False), "_lead_before": Running("peak", lead, own=False)})
    placed = got.withColumn("written_at", F.greatest(F.lit(0), "_lead") + F.col("_sum") - size)
    before = F.greatest(F.lit(0), "_lead_before") + F.coalesce("_sum_before", F.lit(0))
    return placed.withColumn("silence", F.col("written_at") - before).drop("_sum", "_lead", "_sum_before", "_lead_before")


def held(df: DataFrame, stream: Stream, pressed: Column, every: int = 18, name: str = "fires") -> DataFrame:
    """df with whether a key fires: when it goes down, and again after every `every` rows while it is held."""
    rows = df.withColumn("_down", F.coalesce(pressed, F.lit(False)))
    one = F.lit(1).cast("long")
    up = running(rows, stream, {"_rank": ("sum", one), "_up": Running("peak", (one, F.when(~F.col("_down"), F.lit(0))))})
    since = F.col("_rank") - F.coalesce("_up", F.lit(0)) - 1
    return up.withColumn(name, F.col("_down") & (since % every == 0)).drop("_rank", "_down", "_up")
