"""Quality steps, best first, and the first one whose streams fit a byte budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import mib
from tideline.sources.stored import stored

from .ordered import Stream, running, within_budget

# The quality steps, best first (half resolution, frames a second, codebook size, skip threshold).
STEPS = [
    (False, 20, 256, 600),
    (False, 15, 256, 600),
    (False, 15, 128, 1500),
    (False, 12, 128, 3000),
    (False, 10, 64, 3000),
    (True, 15, 256, 600),
    (True, 10, 128, 3000),
]
#: What a record costs beyond its own bytes.
RECORD_COST = 4


def steps(spark: SparkSession, fps: int | None = None, half_res: bool = False) -> DataFrame:
    """(step_no, half_res, fps, codebook, skip): the steps to try in order; a fixed fps makes some equal, of which the first stays."""
    ladder = spark.createDataFrame([(i, *s) for i, s in enumerate(STEPS)], "step_no int, half_res boolean, fps int, codebook int, skip int")
    if half_res:
        ladder = ladder.where("half_res")
    if fps is not None:
        ladder = ladder.withColumn("fps", F.lit(fps))
    return ladder.groupBy("half_res", "fps", "codebook", "skip").agg(F.min("step_no").alias("step_no"))


def candidates(fps: Column, half_only: Column) -> Column:
    """An array of struct(half_res, fps, codebook, skip, step_no): the steps to try for a row, in order.

    fps: a rate that all steps take, or null; steps that become equal by it are tried once. half_only: only half resolution."""
    fields = ["half_res", "fps", "codebook", "skip"]
    ladder = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip([*fields, "step_no"], [*step, i], strict=True)]) for i, step in enumerate(STEPS)])
    wanted = F.filter(ladder, lambda s: s["half_res"] | ~F.coalesce(half_only, F.lit(False)))
    pinned = F.transform(wanted, lambda s: s.withField("fps", F.coalesce(fps.cast("int"), s["fps"])))
    alike = F.transform(pinned, lambda s: F.struct(*[s[n] for n in fields]))
    return F.filter(pinned, lambda s, i: F.array_position(alike, F.struct(*[s[n].alias(n) for n in fields])) == i + 1)


def first_fit(costs: DataFrame, keys: list[str], step: str, cost: Column, seconds: Column, limit: Column | int) -> DataFrame:
    """For each key the first step whose total cost is within the limit, or how many seconds the best step held.

    costs: a row per key, step and segment, with what the segment costs and how many seconds it lasts, in order of its
    column `segment`. A step's seconds are those of its segments before the first that doesn't fit: costs are positive,
    so the running sum tells. Only totals per (key, step) meet.
    """
    rows = costs.withColumns({"_cost": cost, "_secs": seconds, "_limit": limit if isinstance(limit, Column) else F.lit(limit)})
    stream = Stream([*keys, step], ["segment"], F.floor(F.col("segment") / 4096))
    held = running(rows, stream, {"_used": ("sum", F.col("_cost"))})
    totals = held.groupBy(*keys, step).agg((F.sum("_cost") <= F.first("_limit")).alias("fits"), F.sum(F.when(F.col("_used") <= F.col("_limit"), F.col("_secs"))).alias("secs"))
    return totals.groupBy(*keys).agg(F.min(F.when(F.col("fits"), F.col(step))).alias("step_no"), F.max(F.when(~F.col("fits"), F.coalesce("secs", F.lit(0)))).alias("held_secs")).withColumn("best_secs", F.when(F.col("step_no").isNull(), F.col("held_secs"))).drop("held_secs")


@dataclass(frozen=True)
class Step:
    """A quality step: frames a second, entries of a codebook, squared distance that sends a block again, half resolution."""

    fps: int
    codebook: int
    skip: float
    half_res: bool = False


def at_rate(frames: DataFrame, frame: str, source_fps: int, fps: int) -> DataFrame:
    """The frames (numbered from 0 at source_fps) that are shown at a lower rate, numbered anew: frame j shows the source's frame j * source_fps / fps, rounded down."""
    j = F.ceil(F.col(frame) * fps / source_fps).cast("long")
    return frames.withColumn("_j", j).where(F.floor(F.col("_j") * source_fps / fps) == F.col(frame)).withColumn(frame, F.col("_j")).drop("_j")


def searched(frames: DataFrame, keys: list[str], clip: str, frame: str, ladder: list[Step], encode: Callable[[DataFrame, Step], DataFrame], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first step, best first, whose records fit the limit, for each key; and the records of these steps.

    A key's clips share its limit in their order: a record costs its bytes and RECORD_COST, and after the first that doesn't
    fit none does. encode gives (keys, clip, frame, record) of the frames of the keys it gets at a step. A step is encoded only
    for keys that no earlier one fitted; it is written once and read again for sums and records. Returns (keys, step_no,
    n_bytes, best_secs), where best_secs is how many seconds the step that held most of them held, of keys that no step
    fits, and (keys, clip, frame, record, step_no)."""
    left, tried = None, []
    for number, step in enumerate(ladder):
        rows = frames if left is None else frames.join(left, keys, "left_semi")
        records = stored(encode(rows, step).select(*keys, clip, frame, "record"), "ladder-records")
        stream = Stream(keys, [clip, frame], F.struct(F.col(clip), F.floor(F.col(frame) / 4096)))
        held = within_budget(records, stream, F.coalesce(F.octet_length("record"), F.lit(0)) + RECORD_COST, limit)
        totals = held.groupBy(*keys).agg(F.every("fits").alias("fit"), F.sum(F.coalesce(F.octet_length("record"), F.lit(0)) + RECORD_COST).alias("n_bytes"), F.count_if("fits").alias("held"))
        totals = stored(totals.select(*keys, "fit", "n_bytes", (F.col("held") / step.fps).alias("secs"), F.lit(number).alias("step_no")), "ladder-totals")
        tried.append((records, totals))
        left = totals.where("NOT fit").select(*keys)
        if left.isEmpty():
            break
    every = tried[0][1]
    for _, more in tried[1:]:
        every = every.union(more)
    fits = F.col("fit")
    summary = every.groupBy(*keys).agg(F.min(F.when(fits, F.col("step_no"))).alias("step_no"), F.min(F.when(fits, F.col("n_bytes"))).alias("n_bytes"), F.max("secs").alias("secs"))
    summary = summary.select(*keys, "step_no", "n_bytes", F.when(F.col("step_no").isNull(), F.col("secs")).alias("best_secs"))
    chosen = [r.join(t.where("fit").select(*keys, "step_no"), keys) for r, t in tried]
    records = chosen[0]
    for more in chosen[1:]:
        records = records.union(more)
    return summary, records


def _whole(seconds: Column) -> Column:
    return F.rint(seconds).cast("long").cast("string")


def too_big(seconds: Column, limit: Column, best_secs: Column, hint: str) -> Column:
    """What to say of clips that no step fits."""
    return F.concat(F.lit("the clip ("), _whole(seconds), F.lit("s) doesn't fit in "), mib(limit), F.lit(" even at the lowest quality; roughly "), _whole(best_secs), F.lit(f"s would fit. {hint}"))


def audio_too_big(seconds: Column, limit: Column, fixed: Column, audio: Column, with_subtitles: Column, hint: str) -> Column:
    """What to say before any frame is read, where what doesn't depend on the step is above the limit already; else null.

    fixed: bytes of everything but frames, the audio among them."""
    rate = audio / F.greatest(seconds, F.lit(0.001))
    fits = F.greatest(limit - (fixed - audio), F.lit(0)) / F.nullif(rate, F.lit(0.0))
    what = F.when(with_subtitles, "the audio and subtitles alone need").otherwise("the audio alone needs")
    said = F.concat(F.lit("the clip ("), _whole(seconds), F.lit("s) doesn't fit in "), mib(limit), F.lit(": "), what, F.lit(" "), mib(audio), F.lit("; roughly "), F.coalesce(_whole(fits), F.lit("0")), F.lit(f"s would fit. {hint}"))
    return F.when(fixed > limit, said)
