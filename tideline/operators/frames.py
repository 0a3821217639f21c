"""Frames as tables of 2x2 blocks: quantised with one codebook, sent only where they change, and put together again.

A clip's frames are cut into groups of bounded length; in a group a block is sent in the first frame of each of the two
alternating pages and later only when it differs enough from what its page shows. Every step is a composition of the
dead-band, nearest-centroid and running-value operators, so the unit of work is a block of a group, not a clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster, segments
from .ordered import Stream, running

PAGES = 2
#: Pixels of a frame that tell a scene cut, and of a clip that give its palette, at most about twice so many.
SCENE_PIXELS, PALETTE_PIXELS = 4_096, 50_000
BLOCK = ["block_x", "block_y"]


def block_vectors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_x, block_y, v): twelve numbers of each 2x2 block, row by row, of pixels (keys, x, y, r, g, b)."""
    at = [F.floor(F.col(c) / 2).alias(f"block_{c}") for c in "xy"]
    four = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    return pixels.groupBy(*keys, *at).agg(F.flatten(F.transform(four, lambda p: F.array(*[p[c].cast("double") for c in "rgb"]))).alias("v"))


def encoded(blocks: DataFrame, clip: str, frame: str, group_frames: int, book: list[list[float]], skip: float) -> DataFrame:
    """(clip, frame, block_x, block_y, sent, code): code is null where a block isn't sent."""
    group = F.floor(F.col(frame) / group_frames).alias("_group")
    rows = blocks.select(clip, frame, *BLOCK, "v", group)
    sent = segments.dead_band(rows, [clip, "_group", *BLOCK], frame, "v", skip, PAGES)
    return sent.select(clip, frame, *BLOCK, "sent", F.when(F.col("sent"), cluster.nearest(F.col("v"), book)).alias("code"))


def decoded(codes: DataFrame, clip: str, frame: str, group_frames: int, book: list[list[float]]) -> DataFrame:
    """(clip, frame, x, y, r, g, b): each block shows the code its page got last."""
    paged = codes.withColumn("_page", F.col(frame) % PAGES)
    shown = running(paged, Stream([clip, *BLOCK, "_page"], [frame], F.floor(F.col(frame) / group_frames)), {"shown": ("last", F.col("code"))})
    table = F.array(*[F.array(*map(F.lit, entry)) for entry in book])
    pixel = F.posexplode(F.sequence(F.lit(0), F.lit(3)))
    rows = shown.select(clip, frame, *BLOCK, F.get(table, F.col("shown")).alias("v"), pixel.alias("_i", "_j"))
    colours = [F.get("v", F.col("_i") * 3 + c).alias(n) for c, n in enumerate("rgb")]
    return rows.select(clip, frame, (F.col("block_x") * 2 + F.col("_i") % 2).alias("x"), (F.col("block_y") * 2 + F.floor(F.col("_i") / 2)).alias("y"), *colours)


def mean_square(a: Column, b: Column) -> Column:
    """An aggregate: the mean squared difference."""
    return F.avg((a - b) * (a - b))


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Decibels of a mean squared error; infinite for none."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(peak * peak) / mse) * 10)


def snr(signal: Column, noise: Column) -> Column:
    """An aggregate: decibels of a signal over its noise."""
    return F.log10(F.sum(signal * signal) / F.sum(noise * noise)) * 10


def rms(x: Column) -> Column:
    """An aggregate: the root of the mean square."""
    return F.sqrt(F.avg(x * x))


def scene_cuts(pixels: DataFrame, clip: str, frame: str, width: int, height: int, limit: int = 40, most: int = SCENE_PIXELS) -> DataFrame:
    """(clip, frame, cut) of every frame after the first: whether the mean change of its samples, as a whole number, is above `limit`.

    Of a frame of width x height pixels every (width * height / most)-th is looked at. The frame before is met by an
    equality join on (clip, frame + 1, x, y), not by a window over a clip's pixels."""
    step = max(1, width * height // most)
    seen = pixels.where((F.col("y") * width + F.col("x")) % step == 0) if step > 1 else pixels
    before = seen.select(clip, (F.col(frame) + 1).alias(frame), "x", "y", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    change = sum((F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb"), F.lit(0))
    means = seen.join(before, [clip, frame, "x", "y"]).groupBy(clip, frame).agg(F.floor(F.sum(change) / (F.count(F.lit(1)) * 3)).alias("mean"))
    return means.select(clip, frame, (F.col("mean") > limit).alias("cut"))


def sampled(pixels: DataFrame, clip: str, frame: str, width: int, height: int, most: int = PALETTE_PIXELS) -> DataFrame:
    """Every n-th pixel of each clip in order of frame (from 0, none missing), row and column, where n is the number of its pixels over `most`."""
    totals = pixels.groupBy(F.col(clip).alias("_clip")).agg(F.greatest(F.floor(F.count(F.lit(1)) / most), F.lit(1)).alias("_step"))  # a row a clip
    index = (F.col(frame) * height + F.col("y")) * width + F.col("x")
    return pixels.join(totals, F.col(clip) == F.col("_clip")).where(index % F.col("_step") == 0).drop("_clip", "_step")


def quality(pixels: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mse, psnr) of what is shown against the pixels, over all three colours."""
    other = shown.select(*keys, "x", "y", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    square = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "rgb"), F.lit(0.0))
    found = pixels.join(other, [*keys, "x", "y"]).groupBy(*keys).agg((F.sum(square) / (F.count(F.lit(1)) * 3)).alias("mse"))
    return found.select(*keys, "mse", psnr(F.col("mse")).alias("psnr"))


def nearest_colours(spark, palette: list[tuple[int, int, int]]) -> DataFrame:  # noqa: ANN001
    """(c555, slot): the nearest palette slot of each 15-bit colour; of equally near ones the lowest."""
    from tideline.functions.media import from_555

    c = from_555(F.col("id").cast("int"))
    vector = F.array(*[c[n].cast("double") for n in "rgb"])
    return spark.range(1 << 15).select(F.col("id").cast("int").alias("c555"), cluster.nearest(vector, [list(map(float, p)) for p in palette]).alias("slot"))


def downmixed(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean over the channels of each place."""
    return samples.groupBy(*keys).agg(F.avg(value).alias(value))
