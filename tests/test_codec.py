"""Packed frames and their records: limits of quality, bytes of known records, corrupt ones, groups, views, the ladder."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import cluster, codec, frames, ladder, packed


def gradient(w, h, shift):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return np.stack([(x + shift) * 4 % 256, y * 5 % 256, (x + y) * 2 % 256], -1).astype(np.uint8)


def solid(w, h, colour):
    return np.tile(np.array(colour, np.uint8), (h, w, 1))


def psnr(a, b):
    mse = ((a.astype(float) - b.astype(float)) ** 2).mean()
    return 10 * np.log10(255 * 255 / max(mse, 1e-9))


def table(spark, stacks):
    rows = [(c, i, bytearray(f.tobytes())) for c, stack in enumerate(stacks) for i, f in enumerate(stack)]
    return spark.createDataFrame(rows, "clip long, frame long, rgb binary")


def shown(spark, stack, codebook, skip, longest=100):
    h, w = stack[0].shape[:2]
    df = table(spark, [stack])
    placed = df.join(packed.grouped(df, "clip", "frame", w, h, longest), ["clip", "frame"])
    records = codec.encoded(placed, "clip", "group", "place", w, h, codebook, skip, carry=["frame"])
    back = codec.decoded(records, "clip", "group", "place", w, h, carry=["frame"])
    rows = {r["frame"]: r for r in back.collect()}
    assert all(r["error"] is None for r in rows.values())
    return [np.frombuffer(rows[i]["rgb"], np.uint8).reshape(h, w, 3) for i in range(len(stack))], {r["frame"]: (bytes(r["record"]), r["group"]) for r in records.collect()}


def test_static_frames_are_all_skips():
    records = codec.group_records(np.stack([gradient(32, 16, 0)] * 4), 256, 600)
    assert records[0][0] == 3 and records[1][0] == 1
    assert list(records[2]) == list(records[3]) == [0, 0, 0, 0, 127, 0, 0, 0]


def test_moving_frames_keep_their_quality_and_records_are_aligned(spark):
    stack = [gradient(64, 48, i * 3) for i in range(6)]
    got, records = shown(spark, stack, 256, 600)
    assert all(psnr(a, b) > 25 for a, b in zip(got, stack, strict=True))
    assert all(len(r) % 4 == 0 for r, _ in records.values())


def test_long_runs_and_full_screens(spark):
    stack = [gradient(240, 160, 0), gradient(240, 160, 0), solid(240, 160, (0, 0, 0))]
    got, records = shown(spark, stack, 256, 600)
    assert psnr(got[2], stack[2]) > 30 and records[2][1] == 1  # a scene cut


def test_one_frame_and_groups_by_cut_and_length(spark):
    got, _ = shown(spark, [solid(16, 16, (10, 200, 30))], 64, 3000)
    assert psnr(got[0], solid(16, 16, (10, 200, 30))) > 30
    stack = [solid(8, 8, (0, 0, 0))] * 3 + [solid(8, 8, (255, 255, 255))] * 7
    _, records = shown(spark, stack, 16, 600, longest=4)
    assert [i for i, (r, _) in sorted(records.items()) if r[0] & 2] == [0, 3, 7]


@pytest.mark.parametrize("seed", range(3))
def test_ops_round_trip_and_are_bounded(seed):
    rng = random.Random(seed)
    codes = np.array([c for _ in range(60) for c in [rng.choice([-1, rng.randrange(200)])] * rng.choice([1, 2, 127, 128, 129, 300])])
    ops = codec.op_stream(codes)
    back, used = codec.expanded(ops + b"\0\0", len(codes), 200)
    assert (back == codes).all() and used == len(ops)
    assert codec.op_stream(np.full(300, -1)) == bytes([127, 127, 43]) and codec.op_stream(np.zeros(0, np.int64)) == b""


def test_corrupt_records_are_refused(spark):
    good = codec.group_records(np.stack([gradient(8, 8, 0), gradient(8, 8, 9)]), 4, 0)[1]
    n = int.from_bytes(good[2:4], "little")
    ops = 4 + 4 * n
    bad = {
        "no record": [None, b"", good[:3], b"\x09" + good[1:], good + b"\0"],
        "the codebook goes beyond the record": [good[:2] + b"\xff\xff" + good[4:]],
        "ops end before the frame does": [good[:ops], good[: ops + 4]],
        "ops go beyond the frame": [good[:ops] + bytes([127, 0, 0, 0])],
        "an op names an entry that the codebook hasn't": [good[: ops + 1] + bytes([n]) + good[ops + 2 :]],
        "bytes remain behind the ops": [good + b"\0\0\0\0", good[:-1] + b"\x01"],
    }
    rows = [(i, error, x) for i, (error, x) in enumerate((e, x) for e, xs in bad.items() for x in xs)]
    df = spark.createDataFrame([(i, e, None if x is None else bytearray(x)) for i, e, x in rows], "i long, want string, record binary")
    got = codec.op_rows(df, ["i", "want"], 16).collect()
    assert len(got) == len(rows) and all(r["error"] == r["want"] and r["block"] is None for r in got)


def test_a_corrupt_record_ends_its_group_only(spark):
    df = table(spark, [[gradient(8, 8, i * 40) for i in range(6)]])
    placed = df.withColumn("group", F.floor(F.col("frame") / 3)).withColumn("place", F.col("frame") % 3)
    records = codec.encoded(placed, "clip", "group", "place", 8, 8, 4, 0, carry=["frame"])
    broken = records.withColumn("record", F.when(F.col("frame") == 1, F.substring("record", 1, 8)).otherwise(F.col("record")))
    got = {r["frame"]: (r["rgb"] is None, r["error"]) for r in codec.decoded(broken, "clip", "group", "place", 8, 8, carry=["frame"]).collect()}
    assert [got[i][0] for i in range(6)] == [False, True, True, False, False, False] and got[1][1] == got[2][1] is not None


def test_wrong_sizes_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(0, 0, bytearray(gradient(8, 8, 0).tobytes())), (0, 1, bytearray(b"abc")), (1, 0, None), (2, 0, bytearray(gradient(8, 8, 0).tobytes()))], "clip long, frame long, rgb binary")
    placed = df.join(packed.grouped(df, "clip", "frame", 8, 8, 4), ["clip", "frame"])
    got = {(r["clip"], r["frame"]): (r["record"] is not None, r["error"] is None) for r in codec.encoded(placed, "clip", "group", "place", 8, 8, 4, 0, carry=["frame"]).collect()}
    assert got == {(0, 0): (False, False), (0, 1): (False, False), (1, 0): (False, False), (2, 0): (True, True)}
    assert packed.block_rows(df, ["clip", "frame"], 8, 8).groupBy("clip", "frame").count().collect() and packed.block_rows(df.limit(0), ["clip", "frame"], 8, 8).count() == 0
    none = placed.limit(0)
    assert codec.encoded(none, "clip", "group", "place", 8, 8, 4, 0).count() == 0 and packed.grouped(df.limit(0), "clip", "frame", 8, 8, 4).count() == 0


def test_pixels_pack_into_frames_and_blocks_come_back(spark):
    f = gradient(6, 4, 3)
    pixels = spark.createDataFrame([(1, x, y, *map(int, f[y, x])) for y in range(4) for x in range(6)], "k long, x long, y long, r long, g long, b long")
    assert bytes(packed.from_pixels(pixels, ["k"]).first()["rgb"]) == f.tobytes()
    assert (packed.unblocked(packed.block_matrix(f[None]), 6, 4)[0] == f).all()
    assert packed.halved(f[None])[0, 0, 0].tolist() == [int(f[:2, :2, c].sum() + 2) // 4 for c in range(3)]


@pytest.mark.parametrize(("scale", "x", "y"), [(256, 0, 0), (128, 0, 0), (256, -256 * 300, 0), (390, -300, 200)])
def test_affine_views(spark, scale, x, y):
    f = gradient(8, 6, 1)
    got = np.frombuffer(packed.viewed(table(spark, [[f]]), ["clip", "frame"], 8, 6, 8, 6, scale, x, y).first()["rgb"], np.uint8).reshape(6, 8, 3)
    for j in range(6):
        for i in range(8):
            tx, ty = (x + scale * i) >> 8, (y + scale * j) >> 8
            assert (got[j, i] == (f[ty, tx] if 0 <= tx < 8 and 0 <= ty < 6 else 0)).all()


def test_palettes_and_grouped_centres(spark):
    colours = np.array([[255, 0, 0], [0, 255, 0], [0, 0, 255], [128, 128, 128]])
    words = codec.palette_of(np.tile(colours, (100, 1)))
    assert words[0] == 0
    slots = codec.Slots(words)
    for c in colours:
        assert codec.colour_bytes(words)[slots(c[None])[0]].tolist() == codec.colour_bytes(codec.colour_word(c[None]))[0].tolist()
    assert codec.palette_of(np.zeros((0, 3))).tolist() == [0] * 256
    rows = [(g, i, [float(v), 1.0]) for g, vs in (("a", [1, 2, 100, 101]), ("b", [5])) for i, v in enumerate(vs)] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    got = {(r["g"], r["centre"]): r["v"] for r in cluster.grouped_kmeans(df, ["g"], "v", ["i"], 2, 3).collect()}
    assert got == {("a", 0): [1.5, 1.0], ("a", 1): [100.5, 1.0], ("b", 0): [5.0, 1.0]}


def test_the_ladder_tries_later_steps_for_open_keys_only(spark):
    rows = [(k, c, i, bytearray(b"x" * n)) for k, n in (("small", 4), ("mid", 40), ("huge", 900)) for c in range(2) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, clip long, frame long, rgb binary")
    seen = []

    def encode(frames_, step):
        seen.append({r["k"] for r in frames_.select("k").distinct().collect()})
        return frames_.select("k", "clip", "frame", F.expr(f"substring(rgb, 1, greatest(1, octet_length(rgb) * {step.codebook} div 8))").alias("record"))

    steps = [ladder.Step(10, 8, 0), ladder.Step(5, 2, 0), ladder.Step(2, 1, 0)]
    summary, records = ladder.searched(df, ["k"], "clip", "frame", steps, encode, 400)
    got = {r["k"]: (r["step_no"], r["n_bytes"], r["best_secs"]) for r in summary.collect()}
    # 20 records: 8 bytes each; 14 at the second step; 900 // 8 + 4 at the last, of which three fit
    assert got == {"small": (0, 160, None), "mid": (1, 280, None), "huge": (None, None, 3 / 2)}
    assert seen == [{"small", "mid", "huge"}, {"mid", "huge"}, {"huge"}]
    assert {(r["k"], r["step_no"]): r["n"] for r in records.groupBy("k", "step_no").agg(F.count("*").alias("n")).collect()} == {("small", 0): 20, ("mid", 1): 20}


def test_lower_rates_show_the_frame_before(spark):
    df = spark.range(20).select(F.lit(0).alias("clip"), F.col("id").alias("frame"), F.col("id").alias("source"))
    for fps in (20, 15, 12, 10, 7):
        got = {r["frame"]: r["source"] for r in ladder.at_rate(df, "frame", 20, fps).collect()}
        assert got == {j: j * 20 // fps for j in range(fps)}


def test_size_messages(spark):
    one = spark.range(1)
    m = one.select(ladder.too_big(F.lit(600.0), F.lit(32 << 20), F.lit(412.4), "HINT").alias("m")).first()["m"]
    assert m == "the clip (600s) doesn't fit in 32.0 MiB even at the lowest quality; roughly 412s would fit. HINT"
    a = one.select(ladder.audio_too_big(F.lit(6000.0), F.lit(32 << 20), F.lit(40 << 20), F.lit(39 << 20), F.lit(False), "H").alias("m")).first()["m"]
    assert "audio alone" in a and "32.0 MiB" in a and "39.0 MiB" in a and "4769s" in a
    assert one.select(ladder.audio_too_big(F.lit(1.0), F.lit(10), F.lit(10), F.lit(5), F.lit(True), "H").alias("m")).first()["m"] is None
    assert [one.select(text.mib(F.lit(n))).first()[0] for n in (262144, 786432, 1 << 20)] == ["0.2 MiB", "0.8 MiB", "1.0 MiB"]


def test_quality_of_unequal_binaries_is_null(spark):
    df = spark.createDataFrame([(1, bytearray(b"ab"), bytearray(b"ad")), (2, bytearray(b"a"), bytearray(b"ab")), (3, None, bytearray(b"a"))], "k long, a binary, b binary")
    assert {r["k"]: r["mse"] for r in packed.compared(df, ["k"], "a", "b").collect()} == {1: 2.0, 2: None, 3: None}
    assert frames.psnr(F.lit(1.0)) is not None
