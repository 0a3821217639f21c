"""Cartridges as files: all sections back, refused files, commits, aborts and replays."""

import io
import os
import struct

import pytest
from pyspark.sql import functions as F

from tideline.sources import cartridge
from tideline.sources.cartridge import Cartridges


def video(n, size=4, **more):
    return {"fps": 20, "w": 240, "h": 134, "x_off": 0, "y_off": 13, "half_res": False, "audio_samples": 2048, "frames": [bytes([i % 256]) * (size * (1 + i % 3)) for i in range(n)], "audio": [], "cues": []} | more


SPRITES = [(1, 2, b"a" * 256), (3, 4, b"b" * 256)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(Cartridges)
    top = tmp_path_factory.mktemp("cartridges")
    one = cartridge.image_of("A title", [video(5), video(3, audio=[b"x" * 1028, b"y" * 100], cues=[(10, 20, 8, 9, SPRITES), (30, 40, 1, 1, [])], half_res=True, w=120, h=66, y_off=7)])
    (top / "one.bin").write_bytes(one)
    (top / "none.bin").write_bytes(cartridge.image_of("", []))
    (top / ".hidden").write_bytes(b"x")
    return str(top), one


def section(spark, path, name, **options):
    return spark.read.format("cartridges").options(section=name, **options).load(path)


def test_sections_come_back(spark, folder, monkeypatch):
    path, _ = folder
    videos = section(spark, path, "videos").orderBy("video").collect()
    assert [(r["n_frames"], r["w"], r["h"], r["half_res"], r["n_cues"], r["title"], r["fps"]) for r in videos] == [(5, 240, 134, False, 0, "A title", 20), (3, 120, 66, True, 2, "A title", 20)]
    assert (videos[0]["fill"], videos[0]["fill_x"], videos[0]["fill_y"]) == (214, 120 * 256 - 120 * 214, (26 + 134) * 128 - 80 * 214)
    got = section(spark, path, "frames").orderBy("video", "frame").collect()
    assert [(r["video"], r["frame"], bytes(r["record"])) for r in got] == [(v, i, bytes([i]) * (4 * (1 + i % 3))) for v, n in ((0, 5), (1, 3)) for i in range(n)]
    assert [bytes(r["data"]) for r in section(spark, path, "audio").orderBy("block").collect()] == [b"x" * 1028, b"y" * 100]
    cues = section(spark, path, "cues").orderBy("cue").collect()
    assert [(r["start_sample"], r["end_sample"], r["w"], r["h"], [(s["x"], s["y"], bytes(s["tiles"])) for s in r["sprites"]]) for r in cues] == [(10, 20, 8, 9, SPRITES), (30, 40, 1, 1, [])]


def test_ranges_read_only_what_they_need(folder):
    _, data = folder

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.seen += len(got)
            return got

    big = cartridge.image_of("t", [video(1000, 400)])
    view = cartridge.View(Counted(big), len(big))
    v = cartridge.contents(view)[0]
    Counted.seen = 0
    got = list(cartridge.rows_of(view, v, "frames", 10, 12))
    assert [r[1] for r in got] == [10, 11] and Counted.seen < 5000 < len(big)
    assert cartridge.contents(cartridge.View(io.BytesIO(data), len(data)))[1]["n_frames"] == 3


def test_an_image_around_a_cartridge(spark, folder, tmp_path):
    _, data = folder
    marker, origin = b"SLOTSLOT", 0x08000000
    stub = b"\xff" * 300 + marker + struct.pack("<I", origin + 512)
    (tmp_path / "program.bin").write_bytes(stub.ljust(512, b"\0") + data)
    got = section(spark, str(tmp_path), "frames", marker=marker.hex(), origin=str(origin))
    assert got.count() == 8


@pytest.mark.parametrize(("at", "new", "error"), [(0, b"OTHERFMT", "not a cartridge"), (8, struct.pack("<I", 3), "unsupported version 3"), (148, struct.pack("<2I", 1, 1 << 30), "offsets out of range"), (148, struct.pack("<2I", 1 << 20, 160), "offsets out of range")])
def test_corrupt_files_are_refused(folder, at, new, error):
    data = bytearray(folder[1])
    data[at : at + len(new)] = new
    with pytest.raises(ValueError, match=error):
        cartridge.contents(cartridge.View(io.BytesIO(bytes(data)), len(data)))
    with pytest.raises(ValueError, match="not a cartridge"):
        cartridge.contents(cartridge.View(io.BytesIO(b"short"), 5))


def test_offsets_of_records_are_checked(folder):
    data = bytearray(folder[1])
    v = cartridge.contents(cartridge.View(io.BytesIO(bytes(data)), len(data)))[0]
    data[v["frames_at"] : v["frames_at"] + 4] = struct.pack("<I", 1 << 30)
    with pytest.raises(ValueError, match="out of range"):
        list(cartridge.rows_of(cartridge.View(io.BytesIO(bytes(data)), len(data)), v, "frames", 0, 2))


def test_commit_abort_and_names(spark, tmp_path):
    spark.dataSource.register(Cartridges)
    df = spark.createDataFrame([("a.bin", bytearray(b"1")), ("b.bin", bytearray(b"2"))], "name string, image binary")
    df.write.format("cartridges").mode("append").save(str(tmp_path))
    df.where("name = 'a.bin'").withColumn("image", F.lit(b"new")).write.format("cartridges").mode("append").save(str(tmp_path))
    assert {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path)} == {"a.bin": b"new", "b.bin": b"2"}
    bad = spark.createDataFrame([("c.bin", bytearray(b"3")), ("../d.bin", bytearray(b"4"))], "name string, image binary")
    with pytest.raises(Exception, match="no file name"):
        bad.write.format("cartridges").mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["a.bin", "b.bin"]
    df.where("name = 'b.bin'").write.format("cartridges").mode("overwrite").save(str(tmp_path))
    assert os.listdir(tmp_path) == ["b.bin"]


def test_streams_commit_each_batch(spark, tmp_path):
    spark.dataSource.register(Cartridges)
    for i in range(3):
        spark.createDataFrame([(f"{i}.bin", bytearray(bytes([i])))], "name string, image binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, image binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.format("cartridges").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(os.listdir(tmp_path / "out")) == ["0.bin", "1.bin", "2.bin"]


def test_a_replayed_batch_gives_the_same_files(tmp_path):
    for _ in range(2):
        w = cartridge.StreamWriter(str(tmp_path))
        w.commit([w.write(iter([{"name": "x.bin", "image": b"1"}])), None], 7)
    w = cartridge.StreamWriter(str(tmp_path))
    w.abort([w.write(iter([{"name": "y.bin", "image": b"1"}]))], 8)
    assert os.listdir(tmp_path) == ["x.bin"]


def test_assembled_parts_and_those_that_are_too_large(spark):
    rows = [(c, "t", v, kind, no, data and bytearray(data), 20, 8, 8, 0, 0, False, 0) for c, v, kind, no, data in [
        (1, 0, "video", 0, None), (1, 0, "frame", 1, b"bbbb"), (1, 0, "frame", 0, b"aaaa"), (1, 0, "audio", 0, b"zz"),
        (2, 0, "video", 0, None), (2, 0, "frame", 0, b"a" * 2000),
        (3, 0, "frame", 0, b"a"), (4, 0, "video", 0, None), (4, 0, "frame", 0, None),
    ]]
    df = spark.createDataFrame(rows, f"cart long, title string, {cartridge.PART}")
    got = {r["cart"]: (r["image"], r["error"]) for r in cartridge.assembled(df, "cart", "title", 1000).collect()}
    assert got[2] == (None, "more than 1000 bytes") and got[3][1] == got[4][1] == "a part without data or video"
    data = bytes(got[1][0])
    view = cartridge.View(io.BytesIO(data), len(data))
    v = cartridge.contents(view)[0]
    assert [r[2] for r in cartridge.rows_of(view, v, "frames", 0, 2)] == [b"aaaa", b"bbbb"] and v["title"] == "t"
    assert cartridge.assembled(df.limit(0), "cart", "title").count() == 0
