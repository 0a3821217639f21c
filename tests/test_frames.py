"""Frames encoded and shown again: quality limits, unchanged frames, scene cuts, colours."""

from pyspark.sql import functions as F

from tideline.operators import cluster, frames


def gradient(spark, n, shift, w=32, h=16):
    size = w * h
    ids = spark.range(n * size)
    at = ids.select(F.lit(1).alias("clip"), F.floor(F.col("id") / size).alias("frame"), (F.col("id") % w).alias("x"), (F.floor(F.col("id") / w) % h).alias("y"))
    return at.select("*", ((F.col("x") + F.col("frame") * shift) * 4 % 256).alias("r"), (F.col("y") * 5 % 256).alias("g"), ((F.col("x") + F.col("y")) * 2 % 256).alias("b"))


def shown(spark, pixels, k, skip):
    blocks = frames.block_vectors(pixels, ["clip", "frame"]).withColumn("ord", F.xxhash64("frame", "block_x", "block_y")).cache()
    book = cluster.kmeans(blocks, "v", "ord", k, 2)
    codes = frames.encoded(blocks, "clip", "frame", 4, book, skip).cache()
    back = frames.decoded(codes, "clip", "frame", 4, book).select("clip", "frame", "x", "y", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    both = pixels.join(back, ["clip", "frame", "x", "y"])
    mse = both.select(sum((frames.mean_square(F.col(c), F.col(f"_{c}")) for c in "rgb"), F.lit(0.0)).alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert mse["n"] == pixels.count()
    return codes, spark.range(1).select(frames.psnr(F.lit(mse["m"] / 3)).alias("p")).first()["p"]


def test_moving_gradient_keeps_its_quality(spark):
    codes, quality = shown(spark, gradient(spark, 6, 1), 48, 600.0)
    assert quality > 25
    keys = {r["frame"]: r["n"] for r in codes.where("sent").groupBy("frame").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert keys[0] == keys[1] == keys[4] == 128  # the first frame of each page and group


def test_static_frames_send_nothing_after_both_pages_are_full(spark):
    codes, quality = shown(spark, gradient(spark, 4, 0), 48, 600.0)
    assert quality > 25 and codes.where("frame >= 2 AND sent").count() == 0


def test_scene_cuts_and_colours(spark):
    solid = spark.range(6 * 4).select(F.lit(1).alias("clip"), F.floor(F.col("id") / 4).alias("frame"), (F.col("id") % 2).alias("x"), (F.floor(F.col("id") / 2) % 2).alias("y"))
    grey = F.when(F.col("frame") < 3, 0).otherwise(255)
    cuts = frames.scene_cuts(solid.select("*", *[grey.alias(c) for c in "rgb"]), "clip", "frame", 2, 2)
    assert [r["frame"] for r in cuts.where("cut").collect()] == [3]
    slots = frames.nearest_colours(spark, [(0, 0, 0), (255, 255, 255), (255, 255, 255)])
    assert {r["slot"] for r in slots.select("slot").distinct().collect()} == {0, 1}
    stereo = spark.createDataFrame([(0, 1, 2.0), (0, 2, 4.0), (1, 1, 5.0)], "at long, channel long, s double")
    assert sorted(tuple(r) for r in frames.downmixed(stereo, ["at"], "s").collect()) == [(0, 3.0), (1, 5.0)]
    assert abs(stereo.select(frames.rms(F.col("s")).alias("r")).first()["r"] - (45 / 3) ** 0.5) < 1e-9
