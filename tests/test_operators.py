"""Operators against brute force: nulls, ties, empty tables, and any cut into blocks."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import fitting, media, text
from tideline.operators import asof, cluster, intervals, ladder, ordered, segments, signal
from tideline.operators.ordered import Stream
from tideline.sources import subtitles


@pytest.mark.parametrize("width", [1, 3, 1000])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_values_in_any_blocks(spark, width, reverse):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([None, *range(-5, 6)])) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    stream = Stream(["k"], ["at"], F.floor(F.col("at") / width))
    kinds = {n: (n, F.col("v")) for n in ("sum", "max", "min", "last")}
    for own in (True, False):
        got = {r["at"]: tuple(r[n] for n in kinds) for r in ordered.running(df, stream, kinds, with_own=own, reverse=reverse).collect()}
        for k, at, _ in rows:
            before = [v for j, a, v in rows if j == k and ((a < at, a > at)[reverse] or own and a == at) and v is not None]
            last = (before[0] if reverse else before[-1]) if before else None
            assert got[at] == ((sum(before), max(before), min(before), last) if before else (None,) * 4)


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_peaks_and_both_ways_in_one_step(spark, width):
    rng = random.Random(8)
    rows = [(rng.choice([1, None]), i, rng.choice([None, *range(-5, 6)]), rng.choice([None, None, *range(-9, 10)])) for i in range(70)]
    df = spark.createDataFrame(rows, "k long, at long, v long, e long")
    peak = (F.col("v"), F.col("e"))
    asked = {f"{own}{back}": ordered.Running("peak", peak, own=own, reverse=back) for own in (True, False) for back in (True, False)}
    got = {r["at"]: r for r in ordered.running(df, Stream(["k"], ["at"], F.floor(F.col("at") / width)), asked | {"n": ("sum", F.lit(1))}).collect()}
    for k, at, _, _ in rows:
        for name, a in asked.items():
            total, best = 0, None
            for j, i, v, e in rows[::-1] if a.reverse else rows:
                if j == k and (((i > at) if a.reverse else (i < at)) or a.own and i == at):
                    total += v or 0
                    best = best if e is None else max(total + e, total + e if best is None else best)
            assert got[at][name] == best
        assert got[at]["n"] == sum(j == k and i <= at for j, i, _, _ in rows)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_segments_of_many_keys_with_nulls(spark, width):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), i, rng.choice([None, 0.0, 0.0, 0.0, 0.0, 0.0, 300.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, at long, v double")
    stream = Stream(["k"], ["at"], F.floor(F.col("at") / width))
    fused = segments.segmented_by_change(df, stream, F.col("v"), 100, 4)
    apart = segments.segmented(segments.changed_by(df, stream, F.col("v"), 100), stream, F.col("cut"), 4)
    runs = {(r["k"], r["start"]): (r["n"], r["value"]) for r in segments.run_lengths(df, stream, F.col("v"), 3).collect()}
    want, want_runs = {}, {}
    for key in (1, 2, None):
        segment, place, was, begun, runs_at = -1, 0, None, False, 0
        for rank, (_, at, v) in enumerate(r for r in rows if r[0] == key):
            cut = begun and v is not None and was is not None and abs(v - was) > 100
            segment, place = (segment + 1, 0) if not begun or cut or place == 3 else (segment, place + 1)
            want[at] = (cut, segment, place, place == 0)
            if begun and was == v and want_runs[key, runs_at][0] < 3:
                want_runs[key, runs_at] = (want_runs[key, runs_at][0] + 1, v)
            else:
                runs_at = rank
                want_runs[key, rank] = (1, v)
            begun, was = True, v
    for got in (fused, apart):
        assert {r["at"]: (r["cut"], r["segment"], r["place"], r["is_start"]) for r in got.collect()} == want
    assert runs == want_runs


def test_running_on_an_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "k long, at long, v long, place long")
    stream = Stream(["k"], ["at"], F.col("at"))
    assert ordered.ranked(df, stream).count() == 0
    assert segments.run_lengths(df, stream, F.col("v")).count() == 0
    assert asof.asof(df, df, ["k"], "at", "at", "v", F.col("v"), F.col("at")).count() == 0


def test_segments_match_a_sequential_splitter(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 0.0, 0.0, 300.0]) for _ in range(200)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k long, at long, v double")
    stream = Stream(["k"], ["at"], F.floor(F.col("at") / 7))
    got = segments.segmented(segments.changed_by(df, stream, F.col("v"), 100), stream, F.col("cut"), 6)
    seen = {r["at"]: (r["segment"], r["place"]) for r in got.collect()}
    segment, place = -1, 0
    for i, v in enumerate(values):
        if i == 0 or place + 1 >= 6 or abs(v - values[i - 1]) > 100:
            segment, place = segment + 1, 0
        else:
            place += 1
        assert seen[i] == (segment, place)


def test_run_lengths_round_trip(spark):
    rows = [(1, i, c) for i, c in enumerate("aaaabbc" * 3 + "d" * 9)]
    df = spark.createDataFrame(rows, "k long, at long, c string")
    runs = segments.run_lengths(df, Stream(["k"], ["at"], F.floor(F.col("at") / 4)), F.col("c"), 4)
    assert max(r["n"] for r in runs.collect()) == 4
    assert [r["value"] for r in segments.expand_runs(runs).orderBy("place").collect()] == [r[2] for r in rows]


def test_equal_starts_keep_the_later_interval(spark):
    df = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 0, 5), (1, 2, 3, 4), (1, 3, 8, 8)], "k long, id long, s long, e long")
    got = intervals.overlaps_clamped(df, ["k"], "s", "e", "id", F.lit(0))
    assert sorted((r["id"], r["s"], r["e"]) for r in got.collect()) == [(1, 0, 3), (2, 3, 4)]
    cut = intervals.clipped(got, "s", "e", 2, 4)
    assert sorted((r["s"], r["e"]) for r in cut.collect()) == [(0, 1), (1, 2)]


def test_candidates_and_first_fit(spark):
    assert ladder.steps(spark, fps=15).count() == 6
    assert ladder.steps(spark, half_res=True).count() == 2
    costs = spark.createDataFrame([(1, 0, 0, 60), (1, 0, 1, 60), (1, 1, 0, 40), (1, 1, 1, 40), (2, 0, 0, 500)], "k long, step int, segment long, cost long")
    got = {r["k"]: (r["step_no"], r["best_secs"]) for r in ladder.first_fit(costs, ["k"], "step", F.col("cost"), F.lit(2), 100).collect()}
    assert got == {1: (1, None), 2: (None, 0)}


def test_kmeans_finds_two_groups(spark):
    near = [(i, [11.0 + i % 2, 10.0]) for i in range(50)] + [(50 + i, [201.0, 50.0 + i % 2]) for i in range(50)]
    df = spark.createDataFrame(near, "id long, v array<double>")
    assert sorted(cluster.kmeans(df, "v", "id", 2, 4)) == [[11.5, 10.0], [201.0, 50.5]]
    assert cluster.kmeans(df.where("id < 0"), "v", "id", 2, 4) == []
    assert len(cluster.kmeans(df.where("id < 3"), "v", "id", 8, 2)) == 3


def clean_slowly(line):
    out, angle, brace = [], False, False
    for c in line:
        if c == "<":
            angle = True
        elif c == "{":
            brace = True
        elif c == ">" and angle:
            angle = False
        elif c == "}" and brace:
            brace = False
        elif not (angle or brace):
            out.append(c)
    return " ".join("".join(out).split())


def test_markup_of_adversarial_lines(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice("<>{}ab  ") for _ in range(rng.randrange(14))) for _ in range(600)]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    for r in df.select("s", text.clean_markup(F.col("s")).alias("c")).collect():
        assert r["c"] == clean_slowly(r["s"]), r["s"]
    assert [re.sub(text.MARKUP.replace(r"\z", r"\Z"), "", s).split() for s in lines] == [clean_slowly(s).split() for s in lines]


@pytest.mark.parametrize(("s", "want"), [("90", 90), ("1.5", 1.5), ("1:23", 83), ("1:02:03.5", 3723.5), ("90:30", 5430), (" .5 ", 0.5), ("1e1", 10), ("", None), ("abc", None), ("1:75", None), ("-3", None), ("1:2:3:4", None), ("1.5:00", None), ("nan", None), ("1d", None), (None, None)])
def test_parse_time(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(text.parse_time(F.col("s")).alias("t")).first()["t"] == want


def wrap_slowly(s, width, most):
    lines, cur = [], ""
    for word in s.split():
        while len(word) > width:
            if cur:
                lines.append(cur)
                cur = ""
            lines.append(word[:width])
            word = word[width:]
        if not cur:
            cur = word
        elif len(cur) + 1 + len(word) <= width:
            cur += " " + word
        else:
            lines.append(cur)
            cur = word
    lines += [cur] if cur else []
    if len(lines) > most:
        lines = lines[:most]
        lines[-1] = lines[-1][: width - 3] + "..."
    return lines


def test_wrapping(spark):
    rng = random.Random(2)
    cases = ["".join(rng.choice("ab    ") for _ in range(rng.randrange(90))) for _ in range(150)] + ["", "x" * 100, "x" * 20, "ab " * 50]
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    for r in df.select("s", text.wrapped(F.col("s"), 10, 3).alias("w")).collect():
        assert r["w"] == wrap_slowly(r["s"], 10, 3), r["s"]


def rows_slowly(lines, room):
    out = []
    for line in lines:
        words = line.split()
        while words:
            n = max([i for i in range(1, len(words) + 1) if len(" ".join(words[:i])) <= room], default=0)
            out.append(" ".join(words[:n]) if n else words[0][:room])
            words = words[n:] if n else [words[0][room:], *words[1:]]
    return out


def fit_slowly(lines):
    for size in (12, 11, 10, 9):
        rows = rows_slowly(lines, int(232 // (size * 0.5)))
        if len(rows) <= 2:
            return size, rows
    return 9, [rows[0], rows[1][:50].rstrip() + "…"]


def test_fitted_text(spark):
    rng = random.Random(8)
    cases = [["short"], ["word " * 60], ["w" * 50], ["w" * 51 + " x"], ["w" * 300], [], [""], ["a", "", "b\t c", "d"], ["x" * 38 + " " + "y" * 40]]
    for _ in range(150):
        cases.append(["".join(rng.choice("abc    \t") * rng.choice([1, 1, 1, 9]) for _ in range(rng.choice([0, 5, 40, 90]))) for _ in range(rng.randrange(4))])
    df = spark.createDataFrame([(x,) for x in cases], "lines array<string>")
    for r in df.select("lines", fitting.fitted(F.col("lines")).alias("f")).select("lines", "f.size", "f.lines").toDF("given", "size", "rows").collect():
        assert (r["size"], r["rows"]) == fit_slowly(r["given"]), r["given"]
    odd = spark.createDataFrame([(None,), ([None, "one two"],)], "lines array<string>")
    assert [(r["f"]["size"], r["f"]["lines"]) for r in odd.select(fitting.fitted(F.col("lines")).alias("f")).collect()] == [(12, []), (12, ["one two"])]


@pytest.mark.parametrize("white", ["\t", "\n", "\r\n", "\u00a0", "\u2003", "\x0b"])
def test_white_space_of_every_kind_is_stripped(spark, white):
    one = spark.createDataFrame([(f"{white}90{white}", f"{white}1:02,500 {white}", f"{white} A é {white}")], "t string, s string, n string")
    got = one.select(text.parse_time(F.col("t")), text.parse_timestamp(F.col("s")), text.ascii_title(F.col("n"))).first()
    assert tuple(got) == (90.0, 62.5, "A ?")
    doc = f"1\n00:00:01,000{'' if chr(10) in white else white}-->{'' if chr(10) in white else white}00:00:02,000\nhello\n"
    assert subtitles.parsed(spark.createDataFrame([(doc,)], "doc string"), "doc").first()["lines"] == ["hello"]


def test_subtitle_documents(spark):
    docs = [
        "\ufeffWEBVTT\r\n\r\nNOTE x\r\n\r\nid\r\n00:01.000 --> 00:04.500 line:0\r\n<i>two</i>  {x}words\r\nnext\r\n\r\n00:03.000 --> 00:03.000\r\nnone\r\n",
        "1\n00:00:01 --> 00:00:02\nx",
        "",
        None,
        "WEBVTT\n",
        "1\n00:00:01,000 --> 00:00:02,000\n \n\t\n2\n00:00:01,000 --> soon\nb",
        "00:00:01,000 --> 00:00:02,000\n<i></i>\n",
        "1\n00:00:01,000 --> 00:00:02,500\nHello\n<i>world</i>\n\n2\n00:00:03,000 --> 00:00:04,000\nBye -->\n00:00:05,000 --> 00:00:06,000\n",
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    got = {}
    for r in subtitles.parsed(df, "doc", "id").collect():
        got.setdefault(r["id"], []).append(r["error"] or (r["ord"], r["start"], r["end"], r["lines"]))
    assert got == {
        0: [(0, 1.0, 4.5, ["two words", "next"])],
        1: ["line 2: bad timestamp '00:00:01'"],
        2: ["no subtitle cues found"],
        3: ["no text"],
        4: ["no subtitle cues found"],
        5: ["line 6: bad timestamp 'soon'"],
        6: ["no subtitle cues found"],
        7: [(0, 1.0, 2.5, ["Hello", "world"]), (1, 3.0, 4.0, ["Bye -->", "00:00:05,000 --> 00:00:06,000"])],
    }


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "good.srt").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    (tmp_path / "bad.srt").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\n\xff\xfe\n")
    got = {r["title"]: (r["lines"], r["error"]) for r in subtitles.read(spark, str(tmp_path)).collect()}
    assert got == {"good": (["hello"], None), "bad": (None, "not UTF-8")}


def test_layouts(spark):
    sizes = [(1920, 1080, 240, 134, 0, 13), (640, 480, 212, 160, 14, 0), (0, 0, 240, 160, 0, 0), (3, 1000, 2, 160, 118, 0)]
    df = spark.createDataFrame([s[:2] for s in sizes], "w long, h long").select("w", "h", media.layout(F.col("w"), F.col("h"), F.lit(False)).alias("l"))
    for r, s in zip(df.collect(), sizes, strict=True):
        assert (r["l"]["w"], r["l"]["h"], r["l"]["x_off"], r["l"]["y_off"]) == s[2:]


def sine(n, rate, hz, amp):
    return amp * np.sin(2 * np.pi * hz * np.arange(n) / rate)


def blocks_of(spark, x, size, kind):
    rows = [(1, i, i * size, [kind(v) for v in x[i * size : (i + 1) * size]]) for i in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "k long, block long, start long, x array<" + ("double>" if kind is float else "smallint>"))


def test_resampling_does_not_depend_on_the_blocks(spark):
    x = sine(9600, 48000, 440, 0.5)
    runs = []
    for size in (100, 1024, 9600):
        got = signal.resampled(blocks_of(spark, x, size, float), "k", "block", "start", "x", 48000.0, 13379.0)
        runs.append([v for r in got.orderBy("first").collect() for v in r["out"]])
    assert runs[0] == runs[1] == runs[2]
    assert abs(len(runs[0]) - 9600 * 13379 / 48000) <= 2
    stop = signal.resampled(blocks_of(spark, sine(9600, 48000, 8000, 0.5), 1024, float), "k", "block", "start", "x", 48000.0, 13379.0)
    quiet = np.concatenate([r["out"] for r in stop.collect()]) / 32767
    assert np.sqrt((quiet**2).mean()) < 0.2 * 0.5 / np.sqrt(2)


def test_adpcm_round_trip(spark):
    x = np.round(sine(13379, 13379, 440, 10_000)).astype(int)
    coded = signal.adpcm_encoded(blocks_of(spark, x, 2048, int), "k", "block", "x")
    back = np.concatenate([r["samples"] for r in signal.adpcm_decoded(coded, "k", "block").orderBy("block").collect()])[: len(x)]
    noise = ((back - x) ** 2).mean()
    assert 10 * np.log10((x**2).mean() / noise) > 20
    silent = signal.adpcm_encoded(blocks_of(spark, np.zeros(3000, int), 2048, int), "k", "block", "x")
    assert not np.concatenate([r["samples"] for r in signal.adpcm_decoded(silent, "k", "block").collect()]).any()


def coded_in_turn(x, size):
    """Codes of blocks of `size` samples, one after the other."""
    value = index = 0
    out = []
    for i in range(0, len(x), size):
        before = (value, index)
        data, value, index = signal.encode_block(x[i : i + size], value, index)
        out.append((i // size, *before, data))
    return out


def clips():
    rng = np.random.default_rng(5)
    n = np.arange(6000)
    yield "sine", np.round(sine(6000, 13379, 440, 30_000)).astype(int)
    yield "noise", rng.integers(-32768, 32768, 5001)
    yield "extremes", np.where(n % 2, 32767, -32768)[:4096]
    yield "silence", np.zeros(3000, int)
    yield "burst", np.where((n > 2500) & (n < 2600), rng.integers(-30000, 30000, 6000), 3)
    yield "short", np.array([5, -7, 1200])


def test_many_runs_are_coded_like_one():
    runs = [[x[:700], x[:0], x[700:901], x[901:1500]] for _, x in clips() for _ in range(4)]
    value, index = np.arange(len(runs)) * 700 - 8000, np.arange(len(runs)) * 3
    assert len(runs) >= signal.MANY_RUNS
    coded, after_value, after_index = signal.encode_runs(runs, value, index)
    for i, run in enumerate(runs):
        (one,), v, k = signal.encode_runs([run], value[i : i + 1], index[i : i + 1])
        assert (coded[i], after_value[i], after_index[i]) == (one, v[0], k[0])


@pytest.mark.parametrize("rounds", [0, 8])
def test_adpcm_in_spans_equals_coding_in_turn(spark, rounds):
    made = dict(clips())
    rows = [(name, b, [int(v) for v in x[b * 100 : b * 100 + 100]]) for name, x in made.items() for b in range(-(-len(x) // 100))]
    df = spark.createDataFrame(rows, "k string, b long, x array<smallint>").repartition(5)
    got = signal.adpcm_encoded(df, "k", "b", "x", span=4, rounds=rounds)
    assert got.columns == ["k", "b", "pred", "idx", "data"]
    found = {}
    for r in got.collect():
        found.setdefault(r["k"], []).append((r["b"], r["pred"], r["idx"], bytes(r["data"])))
    assert {k: sorted(v) for k, v in found.items()} == {k: coded_in_turn(x, 100) for k, x in made.items()}


def test_adpcm_of_odd_and_empty_tables(spark):
    rows = [(None, 0, [9, None, 300]), (None, 5, None), (None, 9, []), (None, 12, [40]), ("a", None, [7, 7]), ("a", 3, [100, 900, 50])]
    df = spark.createDataFrame(rows, "k string, b int, x array<smallint>").withColumns({"span": F.lit("x"), "coded": F.lit(1), "tail": F.lit(2), "start": F.lit(3)})
    got = {(r["k"], r["b"]): bytes(r["data"]) for r in signal.adpcm_encoded(df, "k", "b", "x", span=2).collect()}
    first, v, i = signal.encode_block(np.array([9, 0, 300]), 0, 0)
    again, w, j = signal.encode_block(np.array([7, 7]), 0, 0)
    assert got == {
        (None, 0): first, (None, 5): b"", (None, 9): b"", (None, 12): signal.encode_block(np.array([40]), v, i)[0],
        ("a", None): again, ("a", 3): signal.encode_block(np.array([100, 900, 50]), w, j)[0],
    }
    assert signal.adpcm_encoded(df.limit(0), "k", "b", "x").count() == 0


def test_titles_cost_no_more_than_their_length(spark):
    texts = ["a" + " " * 200_000 + "b", "_" * 100_000 + "c%%é" + "_" * 100_000, "\x00<>", "😀 abc😀def ghijkl mnop", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    began = time.monotonic()
    got = df.select("i", *[c.alias(n) for n, c in (("t", text.ascii_title(F.col("s"))), ("h", text.header_title(F.col("s"))), ("f", text.output_name(F.col("s"))), ("c", text.output_name(F.col("s"), collapse=True)))]).orderBy("i").collect()
    assert time.monotonic() - began < 15  # minutes with a regular expression that tries every blank's run anew
    assert got[0][1:] == (texts[0], "A" + " " * 11, "a" + "_" * 200_000 + "b", "a_b")
    assert got[1]["h"] == "C" and got[1]["f"] == "c" and got[1]["c"] == "c"
    assert got[2][1:] == ("?<>", "", "video", "video")
    assert got[3][1:] == ("? abc?def ghijkl mnop", " ABCDEF GHIJ", "abc_def_ghijkl_mnop", "abc_def_ghijkl_mnop")
    assert got[4][1:] == (None, None, None, None)
