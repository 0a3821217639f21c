"""The push form of segmentation gives what the batch form gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from tideline.operators import ordered, segments, signal
from tideline.operators.ordered import Stream
from tideline.streaming import running
from tideline.streaming.segments import segmented


def pushed(spark, folder, rows, schema, use, parts=3):
    """The rows that `use` gives for a stream of the rows, file by file."""
    size = -(-len(rows) // parts)
    for part in range(parts):
        spark.createDataFrame(rows[part * size : part * size + size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = f"pushed_{use.__name__}"
    query = use(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(name).collect()


def test_pushed_budget_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 2, i, rng.choice([None, 0, 1, 5])) for i in range(60)]

    def budget(stream):
        return running.within_budget(stream, "k", "at", "n", 40)

    got = {(r["key"], r["ord"]): (r["running_cost"], r["fits"]) for r in pushed(spark, tmp_path, rows, "k long, at long, n long", budget)}
    df = spark.createDataFrame(rows, "k long, at long, n long")
    batch = ordered.within_budget(df, Stream(["k"], ["at"], F.floor(F.col("at") / 16)), F.coalesce("n", F.lit(0)), 40)
    assert got == {(r["k"], r["at"]): (r["running_cost"], r["fits"]) for r in batch.collect()}


def test_pushed_resampling_is_the_beginning_of_the_batch_form(spark, tmp_path):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(900) / 48000)
    rows = [(1, i, float(v)) for i, v in enumerate(x)]

    def resampling(stream):
        return running.resampled(stream, "k", "at", "v", 48000.0, 13379.0)

    got = [r["sample"] for r in sorted(pushed(spark, tmp_path, rows, "k long, at long, v double", resampling), key=lambda r: r["place"])]
    blocks = spark.createDataFrame([(1, 0, 0, x.tolist())], "k long, block long, start long, x array<double>")
    whole = signal.resampled(blocks, "k", "block", "start", "x", 48000.0, 13379.0).first()["out"]
    assert got == whole[: len(got)] and len(whole) - len(got) <= 12


def test_ended_streams_give_their_tails(spark, tmp_path):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(900) / 48000)
    rows = [(k, i, float(v), False) for k in (1, 2) for i, v in enumerate(x)] + [(1, 900, None, True)]
    rows.sort(key=lambda r: (r[1], r[0]))

    def ended(stream):
        return running.resampled(stream, "k", "at", "v", 48000.0, 13379.0, ends="last")

    got = pushed(spark, tmp_path, rows, "k long, at long, v double, last boolean", ended)
    blocks = spark.createDataFrame([(1, 0, 0, x.tolist())], "k long, block long, start long, x array<double>")
    whole = signal.resampled(blocks, "k", "block", "start", "x", 48000.0, 13379.0).first()["out"]
    of = {k: [r["sample"] for r in sorted((r for r in got if r["key"] == k), key=lambda r: r["place"])] for k in (1, 2)}
    assert of[1] == whole and of[2] == whole[: len(of[2])] and len(of[2]) < len(whole)


def test_idle_streams_end_with_the_watermark(spark, tmp_path):
    x = [0.25] * 400
    rows = [(1, i, v, 1000 + i) for i, v in enumerate(x)] + [(2, 0, 0.5, 900_000), (2, 1, 0.5, 990_000), (2, 2, 0.5, 2_000_000)]

    def idle(stream):
        timed = stream.selectExpr("k", "at", "v", "timestamp_millis(ms) AS t").withWatermark("t", "1 second")
        return running.resampled(timed, "k", "at", "v", 48000.0, 13379.0, time="t", idle=5_000)

    got = pushed(spark, tmp_path, rows, "k long, at long, v double, ms long", idle, parts=4)
    blocks = spark.createDataFrame([(1, 0, 0, x)], "k long, block long, start long, x array<double>")
    whole = signal.resampled(blocks, "k", "block", "start", "x", 48000.0, 13379.0).first()["out"]
    assert [r["sample"] for r in sorted((r for r in got if r["key"] == 1), key=lambda r: r["place"])] == whole


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i % 2, i, float(rng.choice([0, 10, 40, 300]))) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "k long, at long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = segmented(stream, "k", "at", "v", 100.0, 7, 600.0).writeStream.format("memory").queryName("pushed").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {(r["key"], r["ord"]): (r["segment"], r["place"], r["sent"]) for r in spark.table("pushed").collect()}
    s = Stream(["k"], ["at"], F.floor(F.col("at") / 16))
    df = spark.createDataFrame(rows, "k long, at long, v double")
    cut = segments.segmented(segments.changed_by(df, s, F.col("v"), 100.0), s, F.col("cut"), 7)
    sent = segments.dead_band(cut, ["k", "segment"], "place", "v", 600.0).withColumnRenamed("sent", "out")
    want = {(r["k"], r["at"]): (r["segment"], r["place"], r["out"]) for r in cut.select("k", "at", "segment", "place").join(sent, ["k", "segment", "place"]).collect()}
    assert got == want
