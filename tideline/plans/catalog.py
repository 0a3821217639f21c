"""Registered queries, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import fitting, media, text
from tideline.operators import asof, cluster, intervals, ladder, ordered, segments, signal
from tideline.operators.ordered import Stream
from tideline.plans import codec_queries, frame_queries
from tideline.sources import subtitles

USERS = Stream(["user_id"], ["ts", "event_id"], "to_date(ts)")
CUSTOMERS = Stream(["o_custkey"], ["o_orderkey"], "floor(o_orderkey / 65536)")
#: Jump of a value that starts a segment, rows of a segment at most, squared distance that counts as a change.
JUMP, LONGEST, SKIP = 100.0, 20, 600.0
#: Second since which event times count.
EPOCH = "2024-01-01"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", *columns)


def _second() -> Column:
    """Whole seconds of an event since EPOCH."""
    return (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit(EPOCH).cast("timestamp"))).cast("long")


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segmented_by_change(_events(spark, sf_dir, "value"), USERS, F.col("value"), JUMP, LONGEST)


def change_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("event_id", "user_id", "segment", "place")


def dead_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.dead_band(_segmented(spark, sf_dir), ["user_id", "segment"], "place", "value", SKIP, 2).select("user_id", "segment", "place", "sent")


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.run_lengths(_events(spark, sf_dir, "event_type"), USERS, F.col("event_type"), 2).select("user_id", "start", "n", F.col("value").alias("event_type"))


def run_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = segments.run_lengths(_events(spark, sf_dir, "event_type"), USERS, F.col("event_type"), 2)
    return segments.expand_runs(runs).select("user_id", "place", F.col("value").alias("event_type"))


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordered.within_budget(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), CUSTOMERS, F.length("o_orderpriority") + ladder.RECORD_COST, 100)
    return got.select("o_orderkey", F.col("running_cost").cast("long").alias("running_cost"), "fits")


def section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordered.offsets(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), CUSTOMERS, media.aligned(F.length("o_orderpriority")))
    return got.select("o_orderkey", "offset")


def _step_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of each user as a segment, for every step: the ladder is a literal array, so nothing is joined."""
    segment = F.datediff(F.to_date("ts"), F.lit(EPOCH).cast("date")).alias("segment")
    days = _events(spark, sf_dir, "props").groupBy("user_id", segment).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.length("props")).alias("bytes"))
    steps = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(fps).alias("fps"), F.lit(book).alias("codebook")) for i, (_, fps, book, _) in enumerate(ladder.STEPS)])
    return days.select("user_id", "segment", "frames", "bytes", F.explode(steps).alias("s")).select("user_id", "segment", "frames", "bytes", "s.*")


def gop_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = _step_costs(spark, sf_dir)
    cost = F.floor(F.col("bytes") * F.col("fps") * F.col("codebook") / 512) + ladder.RECORD_COST * F.col("frames")
    return ladder.first_fit(costs, ["user_id"], "step_no", cost, F.col("frames"), 3000).select("user_id", "step_no", F.col("best_secs").cast("long").alias("best_secs"))


def ladder_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps to try for every part, by the rate that its size stands for (none for every fifth) and its resolution."""
    fps = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))
    steps = ladder.candidates(fps, F.col("p_partkey") % 3 == 0)
    return _t(spark, sf_dir, "part").select("p_partkey", F.explode(steps).alias("s")).select("p_partkey", "s.*")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir, "event_type", "value")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")


def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return asof.asof(left, right, ["user_id"], "ts", "ts", "event_id", F.col("value"), F.to_date("at"), fill=True).select("event_id", "value")


def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return asof.asof(left, right, ["user_id"], "ts", "ts", "event_id", F.col("value"), F.to_date("at"), forward=True).select("event_id", "value")


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "value").select("user_id", "event_id", _second().alias("start"), (_second() + F.floor(F.col("value") * 300)).alias("end"))
    return intervals.overlaps_clamped(e, ["user_id"], "start", "end", "event_id", F.floor(F.col("start") / 86400))


def overlap_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("event_id", "user_id", "start", "end")


def interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clipped(_cues(spark, sf_dir), "start", "end", 500_000, 1_500_000).select("event_id", "user_id", "start", "end")


def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("point_id"), (_second() + 1800).alias("at"))
    got = asof.in_interval(points, _cues(spark, sf_dir), ["user_id"], "at", "start", "end", "event_id", F.col("event_id"), F.floor(F.col("at") / 86400), name="cue_id")
    return got.select("point_id", "cue_id")


def segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.ranked(_events(spark, sf_dir, "event_type"), USERS)
    return asof.segment_bounds(rows, USERS, "rank", F.col("event_type") == "signup").select("event_id", "start_before", "start_after")


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir, "value").select("event_id", "user_id", "ts", _second().alias("start"), F.floor(F.col("value") * 100).alias("length"))
    return ordered.gap_filled(rows, USERS, "start", "length").select("event_id", "written_at", "silence")


def key_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.held(_events(spark, sf_dir, "event_type"), USERS, F.col("event_type").isin("click", "view"), 2).select("event_id", "fires")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    return _t(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", whole.alias("v"))


def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    centroids = cluster.kmeans(rows, "v", "vec_id", 8, 2)
    own = rows.select(cluster.nearest(F.col("v"), centroids).alias("cluster"), "v")
    return own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("v", F.lit(0))).cast("long").alias("sum_first"), F.sum(F.get("v", F.lit(63))).cast("long").alias("sum_last"))


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = cluster.codebook(_vectors(spark, sf_dir), "v", "vec_id", 8, 1)
    return book.select(F.col("code").cast("long").alias("code"), F.array_join(F.transform("entry", lambda x: x.cast("long").cast("string")), ",").alias("entry"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = ((F.col("event_id") * k % 256).cast("int") for k in (7, 13, 29))
    c = media.to_555(r, g, b)
    toned, back = media.tone(r, g, b), media.from_555(c)
    return _events(spark, sf_dir).select("event_id", c.alias("c555"), *[toned[n].alias(f"tone_{n}") for n in "rgb"], *[back[n].alias(f"back_{n}") for n in "rgb"])


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("p_partkey") * 7 % 2000).cast("long"), (F.col("p_size") * 37 % 1100).cast("long")
    fit = media.layout(w, h, F.col("p_partkey") % 2 == 1)
    return _t(spark, sf_dir, "part").select("p_partkey", fit.alias("l")).select("p_partkey", "l.w", "l.h", "l.x_off", "l.y_off", media.fill_scale(F.col("l.w"), F.col("l.h")).alias("scale"))


def sample_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, fps = F.col("o_orderkey"), (F.col("o_custkey") % 30 + 1)
    return _t(spark, sf_dir, "orders").select("o_orderkey", media.frame_step(fps).alias("step"), media.total_samples(frame, fps).alias("samples"), media.due_tick(frame, fps).alias("tick"), media.block_start(media.total_samples(frame, fps)).alias("audio_block"))


def time_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.floor(F.col("value") * 100).cast("long"), F.col("event_id") % 6
    s = (
        F.when(k == 0, (v / 10.0).cast("string"))
        .when(k == 1, F.concat(v.cast("string"), F.lit(":"), (v % 75).cast("string")))
        .when(k == 2, F.concat_ws(":", (v % 9).cast("string"), (v % 61).cast("string"), F.concat((v % 60).cast("string"), F.lit(".5"))))
        .when(k == 3, F.concat(F.lit("-"), v.cast("string")))
        .when(k == 4, F.concat(v.cast("string"), F.lit(".5:00")))
        .otherwise(F.concat(F.lit("1:02:"), v.cast("string"), F.lit(":4")))
    )
    s = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\t"), s, F.lit("\n\u00a0"))).otherwise(s)
    return _events(spark, sf_dir, "value").select("event_id", s.alias("s"), text.parse_time(s).alias("seconds"))


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.floor(F.col("value") * 100).cast("long")
    s = F.format_string("%d:%02d:%02d,%03d", F.floor(v / 3600), v % 70, v % 60, v % 1000)
    return _events(spark, sf_dir, "value").select("event_id", s.alias("s"), text.parse_timestamp(s).alias("seconds"))


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("value") * 100) / 8.0
    return _events(spark, sf_dir, "value").select("event_id", text.clock(s).alias("rounded"), text.clock_floor(s).alias("passed"), text.clock_tenths(s).alias("tenths"))


def markup_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("html", "\n"), text.clean_markup)
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(lines, "\n").alias("clean"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return _t(spark, sf_dir, "documents").select("doc_id", text.ascii_title(t).alias("title"), text.header_title(t).alias("header"), text.output_name(t).alias("file_name"), text.output_name(t, collapse=True).alias("short_name"), text.stem(t).alias("stem"))


def wrapped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.wrapped(text.ascii_title(F.coalesce(F.col("text"), F.lit(""))), 28, 8), "\n").alias("lines"))


def fitted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _t(spark, sf_dir, "conversations").select("conv_id", "turn", fitting.fitted(F.split("text", "\n")).alias("f"))
    return got.select("conv_id", "turn", "f.size", F.array_join("f.lines", "\n").alias("lines"))


def subtitle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\s*\n\s*", "\n").alias("body"), (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2).alias("end"))
    docs = subtitles.written(turns, ["conv_id"], "start", "end", F.col("body"))
    return subtitles.parsed(docs, "document", "conv_id").where("error is null").select("conv_id", "start", "end", F.array_join("lines", "\n").alias("body"))


def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    doc = F.format_string(
        '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":%d,"height":480,"sample_aspect_ratio":"%d:3","tags":{"rotate":"%d"}},{"codec_type":"subtitle","codec_name":"%s"},{"codec_type":"subtitle","codec_name":"subrip"}],"format":{"duration":"%d.25"}}',
        p % 1000 + 16, p % 5 + 1, p % 4 * 90, F.when(p % 2 == 0, "mov_text").otherwise("dvd_subtitle"), p,
    )
    return subtitles.probed(_t(spark, sf_dir, "part").select("p_partkey", doc.alias("doc")), "doc", "p_partkey").select("p_partkey", "width", "height", "duration", "has_audio", F.size("subtitles").alias("n_subtitles"), "text_stream")


def header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.rpad("p_name", 32, "~").cast("binary")
    return _t(spark, sf_dir, "part").select("p_partkey", media.checksum(data, 0, 29).alias("check_byte"), media.little_endian(data, 2, 4).alias("word"), media.little_endian(data, 8, 2).alias("half"))


def _sampled(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    rows = ordered.ranked(_events(spark, sf_dir, "value"), USERS).withColumn("block", F.floor(F.col("rank") / most))
    joined = rows.groupBy("user_id", "block").agg(F.min("rank").alias("start"), F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x"))  # `most` rows at most
    return joined.withColumn("x", F.col("x.value"))


def resampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _sampled(spark, sf_dir, 256).withColumn("x", F.transform("x", lambda v: (v / 500.0).cast("double")))
    got = signal.resampled(blocks, "user_id", "block", "start", "x", 48000.0, 13379.0)
    return got.where("size(out) > 0")


def adpcm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _sampled(spark, sf_dir, 256).withColumn("x", F.transform("x", lambda v: F.least(F.floor(v * 60), F.lit(32767)).cast("smallint")))
    coded = signal.adpcm_encoded(blocks, "user_id", "block", "x")
    return signal.adpcm_decoded(coded, "user_id", "block")


_ALL = [
    change_segments, dead_band, run_lengths, run_expansion, budget_prefix, section_offsets, gop_first_fit, ladder_candidates, asof_backward, asof_forward, overlap_clamp, interval_clip, point_in_interval,
    segment_bounds, gap_fill, key_hold, kmeans_clusters, codebook, colours, layouts, sample_clock, time_strings, timestamps, clocks, markup_removed, titles, wrapped_titles, fitted_lines,
    subtitle_round_trip, probe_json, header_bytes, resampled_values, adpcm_round_trip,
]
QUERIES = {f.__name__: f for f in _ALL} | frame_queries.QUERIES | codec_queries.QUERIES

_SEGMENTS = f"""
    lagged AS (SELECT *, row_number() OVER w - 1 AS r, coalesce(abs(value - lag(value) OVER w) > {JUMP}, true) AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    scenes AS (SELECT *, max(CASE WHEN cut THEN r END) OVER (PARTITION BY user_id ORDER BY r) AS s FROM lagged),
    places AS (SELECT *, (r - s) % {LONGEST} AS place FROM scenes),
    segs AS (SELECT event_id, user_id, value, CAST(sum(CASE WHEN place = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY r) AS BIGINT) - 1 AS segment, place FROM places)"""
_RUNS = """
    a AS (SELECT user_id, event_type, row_number() OVER w - 1 AS r, coalesce(event_type <> lag(event_type) OVER w, true) AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, max(CASE WHEN f THEN r END) OVER (PARTITION BY user_id ORDER BY r) AS s FROM a)"""
_SECOND = f"CAST(floor(epoch(ts) - epoch(TIMESTAMP '{EPOCH}')) AS BIGINT)"
_CUES = f"""
    raw AS (SELECT user_id, event_id, {_SECOND} AS s, {_SECOND} + CAST(floor(value * 300) AS BIGINT) AS e FROM events),
    nxt AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM raw WHERE e > s),
    cues AS (SELECT event_id, user_id, s AS start, CASE WHEN n < e THEN n ELSE e END AS "end" FROM nxt WHERE CASE WHEN n < e THEN n ELSE e END > s)"""
_STEP_ROWS = ", ".join(f"({i}, {str(h).lower()}, {f}, {c}, {s})" for i, (h, f, c, s) in enumerate(ladder.STEPS))
_LADDER = f"ladder(step_no, half_res, fps, codebook, skip) AS (VALUES {_STEP_ROWS})"


def _kmeans_sql(k: int, rounds: int) -> str:
    """Common table expressions c0, c1, ... (c, i, x): the centroids after each round."""
    parts = [
        "pts AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64))) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)",
        "sums AS (SELECT vec_id, row_number() OVER (ORDER BY sum(x), vec_id) - 1 AS r, count(*) OVER () AS n FROM pts GROUP BY vec_id)",
        f"c0 AS MATERIALIZED (SELECT j AS c, i, x FROM sums, range({k}) t(j), pts WHERE r = (2 * j + 1) * n // (2 * {k}) AND pts.vec_id = sums.vec_id)",
    ]
    for t in range(rounds):
        parts += [
            f"d{t} AS MATERIALIZED (SELECT vec_id, c, sum((p.x - q.x) * (p.x - q.x)) AS d FROM pts p JOIN c{t} q USING (i) GROUP BY vec_id, c)",
            f"n{t} AS MATERIALIZED (SELECT vec_id, c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k FROM d{t}) WHERE k = 1)",
            f"c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce(m, o.x) AS x FROM c{t} o LEFT JOIN (SELECT c, i, avg(x) AS m FROM pts JOIN n{t} USING (vec_id) GROUP BY c, i) USING (c, i))",
        ]
    return ",\n".join(parts)


#: White space as RE2 writes it.
_WHITE = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _clean_sql(line: str) -> str:
    pattern = text.MARKUP.replace("*+", "*")
    return f"trim(regexp_replace(regexp_replace({line}, '{pattern}', '', 'g'), '{_WHITE}', ' ', 'g'))"


def _stripped_sql(s: str) -> str:
    return f"regexp_replace({s}, '^{_WHITE}|{_WHITE}$', '', 'g')"


_T = "coalesce(text, '')"
_NAME = "regexp_replace(regexp_replace({t}, '[^A-Za-z0-9-]{p}', '_', 'g'), '^_+|_+$', '', 'g')"
_V = "CAST(floor(value * 100) AS BIGINT)"

_ADPCM = f"""
    pcm AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(least(floor(coalesce(value, 0) * 60), 32767) AS INTEGER) AS x FROM events),
    state AS (
        SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS i, 0 AS pred, 0 AS idx FROM pcm
        UNION ALL
        SELECT user_id, i, greatest(-32768, least(32767, pred + CASE WHEN x < pred THEN -1 ELSE 1 END * ((step >> 3) + b4 * step + b2 * (step >> 1) + b1 * (step >> 2)))),
            greatest(0, least(88, idx + CASE WHEN b4 = 0 THEN -1 ELSE 2 + 4 * b2 + 2 * b1 END))
        FROM (SELECT *, CAST(rest - b4 * step - b2 * (step >> 1) >= step >> 2 AS INTEGER) AS b1
            FROM (SELECT *, CAST(rest - b4 * step >= step >> 1 AS INTEGER) AS b2
                FROM (SELECT *, CAST(rest >= step AS INTEGER) AS b4
                    FROM (SELECT p.user_id, p.i, p.x, s.pred, s.idx, abs(p.x - s.pred) AS rest, ({signal.STEP_SIZES})[s.idx + 1] AS step
                        FROM state s JOIN pcm p ON p.user_id IS NOT DISTINCT FROM s.user_id AND p.i = s.i + 1))))),
    ends AS (SELECT user_id, max(i) AS i FROM state GROUP BY user_id),
    heard AS (SELECT user_id, i, pred FROM state WHERE i >= 0
        UNION ALL
        SELECT s.user_id, s.i + 1, least(32767, s.pred + (({signal.STEP_SIZES})[s.idx + 1] >> 3)) FROM state s JOIN ends e ON e.user_id IS NOT DISTINCT FROM s.user_id AND e.i = s.i WHERE s.i % 2 = 0)"""

ORACLE_SQL = {
    "adpcm_round_trip": f"WITH RECURSIVE {_ADPCM} SELECT user_id, i // 256 AS block, list(CAST(pred AS SMALLINT) ORDER BY i) AS samples FROM heard GROUP BY user_id, i // 256",
    "change_segments": f"WITH {_SEGMENTS} SELECT event_id, user_id, segment, place FROM segs",
    "dead_band": f"""WITH RECURSIVE {_SEGMENTS}, fold AS (
        SELECT user_id, segment, place, value AS cur, CAST(NULL AS DOUBLE) AS other, true AS sent FROM segs WHERE place = 0
        UNION ALL
        SELECT s.user_id, s.segment, s.place, CASE WHEN f.other IS NULL OR (s.value - f.other) * (s.value - f.other) > {SKIP} THEN s.value ELSE f.other END, f.cur, f.other IS NULL OR (s.value - f.other) * (s.value - f.other) > {SKIP}
        FROM fold f JOIN segs s ON s.user_id = f.user_id AND s.segment = f.segment AND s.place = f.place + 1)
        SELECT user_id, segment, place, sent FROM fold""",
    "run_lengths": f"WITH {_RUNS} SELECT user_id, min(r) AS start, count(*) AS n, any_value(event_type) AS event_type FROM b GROUP BY user_id, s, (r - s) // 2",
    "run_expansion": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_type FROM events",
    "budget_prefix": "SELECT o_orderkey, CAST(sum(length(o_orderpriority) + 4) OVER w AS BIGINT) AS running_cost, sum(length(o_orderpriority) + 4) OVER w <= 100 AS fits FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "section_offsets": "SELECT o_orderkey, CAST(coalesce(sum((length(o_orderpriority) + 3) // 4 * 4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM orders",
    "gop_first_fit": f"""WITH {_LADDER}, days AS (SELECT user_id, date_diff('day', DATE '{EPOCH}', CAST(ts AS DATE)) AS segment, count(*) AS frames, sum(length(props)) AS bytes FROM events GROUP BY 1, 2),
        costs AS (SELECT user_id, step_no, frames, segment, CAST(bytes AS BIGINT) * fps * codebook // 512 + 4 * frames AS cost FROM days, ladder),
        held AS (SELECT *, sum(cost) OVER (PARTITION BY user_id, step_no ORDER BY segment) AS used FROM costs),
        tot AS (SELECT user_id, step_no, sum(cost) <= 3000 AS fits, coalesce(sum(frames) FILTER (used <= 3000), 0) AS secs FROM held GROUP BY 1, 2)
        SELECT user_id, min(step_no) FILTER (fits) AS step_no, CAST(CASE WHEN min(step_no) FILTER (fits) IS NULL THEN max(secs) END AS BIGINT) AS best_secs FROM tot GROUP BY user_id""",
    "ladder_candidates": f"""WITH {_LADDER}, each AS (SELECT p_partkey, half_res, CAST(CASE WHEN p_partkey % 5 <> 0 THEN p_size ELSE fps END AS INT) AS fps, codebook, skip, step_no FROM part, ladder WHERE half_res OR p_partkey % 3 <> 0)
        SELECT p_partkey, half_res, fps, codebook, skip, min(step_no) AS step_no FROM each GROUP BY p_partkey, half_res, fps, codebook, skip""",
    "asof_backward": """WITH r AS (SELECT * FROM events WHERE event_type = 'view'), f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS first FROM r GROUP BY 1)
        SELECT l.event_id, coalesce(r.value, f.first) AS value FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts LEFT JOIN f ON l.user_id = f.user_id WHERE l.event_type = 'purchase'""",
    "asof_forward": "SELECT l.event_id, r.value FROM events l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts <= r.ts WHERE l.event_type = 'purchase'",
    "overlap_clamp": f"WITH {_CUES} SELECT * FROM cues",
    "interval_clip": f'WITH {_CUES} SELECT event_id, user_id, greatest(start - 500000, 0) AS start, least("end", 1500000) - 500000 AS "end" FROM cues WHERE "end" > 500000 AND start < 1500000',
    "point_in_interval": f'WITH {_CUES}, points AS (SELECT user_id, event_id AS point_id, {_SECOND} + 1800 AS t FROM events) SELECT point_id, event_id AS cue_id FROM points p LEFT JOIN cues c ON c.user_id = p.user_id AND c.start <= p.t AND p.t < c."end"',
    "segment_bounds": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events)
        SELECT event_id, coalesce(max(CASE WHEN event_type = 'signup' THEN r END) OVER (PARTITION BY user_id ORDER BY r), 0) AS start_before,
        min(CASE WHEN event_type = 'signup' THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS start_after FROM a""",
    "gap_fill": f"""WITH RECURSIVE a AS (SELECT event_id, user_id, {_SECOND} AS s, CAST(floor(value * 100) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
        w AS (SELECT user_id, r, event_id, greatest(s, 0) AS written_at, greatest(s, 0) AS silence, greatest(s, 0) + n AS e FROM a WHERE r = 1
        UNION ALL SELECT a.user_id, a.r, a.event_id, greatest(a.s, w.e), greatest(a.s, w.e) - w.e, greatest(a.s, w.e) + a.n FROM w JOIN a ON a.user_id = w.user_id AND a.r = w.r + 1)
        SELECT event_id, written_at, silence FROM w""",
    "key_hold": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, event_type IN ('click', 'view') AS d FROM events),
        b AS (SELECT *, r - coalesce(max(CASE WHEN NOT d THEN r END) OVER (PARTITION BY user_id ORDER BY r), -1) - 1 AS n FROM a) SELECT event_id, d AND n % 2 = 0 AS fires FROM b""",
    "kmeans_clusters": f"""WITH {_kmeans_sql(8, 3)} SELECT c AS cluster, count(*) AS n, CAST(sum(a.x) AS BIGINT) AS sum_first, CAST(sum(z.x) AS BIGINT) AS sum_last
        FROM n2 JOIN pts a ON a.vec_id = n2.vec_id AND a.i = 0 JOIN pts z ON z.vec_id = n2.vec_id AND z.i = 63 GROUP BY c""",
    "codebook": f"""WITH {_kmeans_sql(8, 1)}, e AS (SELECT DISTINCT list(CAST(floor(x) AS BIGINT) ORDER BY i) AS entry FROM c1 GROUP BY c)
        SELECT row_number() OVER (ORDER BY entry) - 1 AS code, array_to_string(entry, ',') AS entry FROM e""",
    "colours": f"""WITH a AS (SELECT event_id, CAST(event_id * 7 % 256 AS INT) AS r, CAST(event_id * 13 % 256 AS INT) AS g, CAST(event_id * 29 % 256 AS INT) AS b FROM events),
        t AS (SELECT *, pow(r / 255.0, {media.GAMMA}) * 255.0 AS u, pow(g / 255.0, {media.GAMMA}) * 255.0 AS v, pow(b / 255.0, {media.GAMMA}) * 255.0 AS w, (r >> 3) | ((g >> 3) << 5) | ((b >> 3) << 10) AS c FROM a),
        y AS (SELECT *, u * 0.299 + v * 0.587 + w * 0.114 AS l FROM t)
        SELECT event_id, c AS c555, {", ".join(f"CAST(least(greatest(round(l + ({x} - l) * {media.SATURATION}), 0), 255) AS INT) AS tone_{n}" for x, n in zip("uvw", "rgb", strict=True))},
        {", ".join(f"(((c >> {s}) & 31) << 3) | (((c >> {s}) & 31) >> 2) AS back_{n}" for s, n in zip((0, 5, 10), "rgb", strict=True))} FROM y""",
    "layouts": """WITH a AS (SELECT p_partkey, p_partkey * 7 % 2000 AS w, p_size * 37 % 1100 AS h, CASE WHEN p_partkey % 2 = 1 THEN 120 ELSE 240 END AS bw, CASE WHEN p_partkey % 2 = 1 THEN 80 ELSE 160 END AS bh FROM part),
        b AS (SELECT *, CASE WHEN w <= 0 OR h <= 0 OR w * bh >= h * bw THEN bw ELSE w * bh // h END AS fw, CASE WHEN w <= 0 OR h <= 0 OR w * bh < h * bw THEN bh ELSE h * bw // w END AS fh FROM a),
        c AS (SELECT p_partkey, bw, bh, CAST(greatest(fw - fw % 2, 2) AS BIGINT) AS w, CAST(greatest(fh - fh % 2, 2) AS BIGINT) AS h FROM b)
        SELECT p_partkey, w, h, CAST((bw - w) // 2 - (bw - w) // 2 % 2 AS BIGINT) AS x_off, CAST((bh - h) // 2 AS BIGINT) AS y_off, CAST(floor(least(w / 240.0, h / 160.0) * 256) AS INT) AS scale FROM c""",
    "sample_clock": """WITH a AS (SELECT o_orderkey, CAST((13379 << 16) // (o_custkey % 30 + 1) AS BIGINT) AS step FROM orders), b AS (SELECT *, (o_orderkey * step) >> 16 AS samples FROM a)
        SELECT o_orderkey, step, samples, CAST(ceil(o_orderkey * step / CAST(224 << 16 AS DOUBLE)) AS BIGINT) AS tick, samples - samples % 2048 AS audio_block FROM b""",
    "time_strings": f"""WITH a AS (SELECT event_id, {_V} AS v, event_id % 6 AS k FROM events),
        b AS (SELECT *, CASE k WHEN 0 THEN CAST(v / 10.0 AS VARCHAR) WHEN 1 THEN v || ':' || v % 75 WHEN 2 THEN v % 9 || ':' || v % 61 || ':' || v % 60 || '.5' WHEN 3 THEN '-' || v WHEN 4 THEN v || '.5:00' ELSE '1:02:' || v || ':4' END AS s FROM a)
        SELECT event_id, CASE WHEN event_id % 5 = 0 THEN chr(9) || s || chr(10) || chr(160) ELSE s END AS s, CASE k WHEN 0 THEN v / 10.0 WHEN 1 THEN CASE WHEN v % 75 < 60 THEN v * 60.0 + v % 75 END WHEN 2 THEN CASE WHEN v % 61 < 60 THEN v % 9 * 3600.0 + v % 61 * 60 + v % 60 + 0.5 END WHEN 3 THEN CASE WHEN v = 0 THEN 0.0 END END AS seconds FROM b""",
    "timestamps": f"""WITH a AS (SELECT event_id, {_V} AS v FROM events) SELECT event_id, format('{{:d}}:{{:02d}}:{{:02d}},{{:03d}}', v // 3600, v % 70, v % 60, v % 1000) AS s,
        CASE WHEN v % 70 < 60 THEN v // 3600 * 3600 + v % 70 * 60 + v % 60 + v % 1000 / 1000.0 END AS seconds FROM a""",
    "clocks": f"""WITH a AS (SELECT event_id, {_V} / 8.0 AS s FROM events), b AS (SELECT *, CAST(round(s) AS BIGINT) AS n, CAST(floor(s) AS BIGINT) AS f, CAST(round(s * 10) AS BIGINT) AS t FROM a)
        SELECT event_id, lpad(CAST(least(n // 60, 99) AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') AS rounded, lpad(CAST(least(f // 60, 99) AS VARCHAR), 2, '0') || ':' || lpad(CAST(f % 60 AS VARCHAR), 2, '0') AS passed,
        t // 600 || ':' || lpad(CAST(t % 600 // 10 AS VARCHAR), 2, '0') || '.' || t % 10 AS tenths FROM b""",
    "markup_removed": f"SELECT page_id, array_to_string(list_transform(string_split(html, chr(10)), lambda l: {_clean_sql('l')}), chr(10)) AS clean FROM pages",
    "titles": f"""SELECT doc_id, regexp_replace({_stripped_sql(_T)}, '[^ -~]', '?', 'g') AS title, upper(substring(regexp_replace({_T}, '[^A-Za-z0-9 ]', '', 'g'), 1, 12)) AS header,
        coalesce(nullif({_NAME.format(t=_T, p="")}, ''), 'video') AS file_name, coalesce(nullif({_NAME.format(t=_T, p="+")}, ''), 'video') AS short_name, regexp_replace({_T}, '(.)\\.[^.]*$', '\\1') AS stem FROM documents""",
    "wrapped_titles": f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split(regexp_replace({_stripped_sql(_T)}, '[^ -~]', '?', 'g'), ' '), lambda w: w <> '') AS w FROM documents),
        parts AS MATERIALIZED (SELECT doc_id, flatten(list_transform(w, lambda w: list_transform(range(0, (length(w) - 1) // 28 + 1), lambda i: {{'p': substring(w, i * 28 + 1, 28), 'part': length(w) > 28, 'over': i * 28 + 28 < length(w)}}))) AS a FROM words),
        fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS lines, '' AS cur FROM parts
        UNION ALL SELECT doc_id, k + 1, CASE WHEN x.over THEN list_append(done, x.p) ELSE done END, CASE WHEN x.over THEN '' WHEN joins THEN cur || ' ' || x.p ELSE x.p END
        FROM (SELECT *, CASE WHEN cur = '' OR joins THEN lines ELSE list_append(lines, cur) END AS done
            FROM (SELECT doc_id, k, lines, cur, a[k + 1] AS x, cur <> '' AND NOT a[k + 1].part AND length(cur) + 1 + length(a[k + 1].p) <= 28 AS joins FROM fold JOIN parts USING (doc_id) WHERE k < len(a) AND len(lines) <= 8) s) t),
        whole AS (SELECT doc_id, arg_max(CASE WHEN cur = '' THEN lines ELSE list_append(lines, cur) END, k) AS l FROM fold GROUP BY doc_id)
        SELECT doc_id, array_to_string(CASE WHEN len(l) > 8 THEN list_append(l[1:7], substring(l[8], 1, 25) || '...') ELSE l END, chr(10)) AS lines FROM whole""",
    "fitted_lines": f"""WITH RECURSIVE src AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda l: list_filter(regexp_split_to_array(l, '{_WHITE}'), lambda w: w <> '')), lambda l: len(l) > 0) AS ls FROM conversations),
        words AS MATERIALIZED (SELECT conv_id, turn, flatten(list_transform(coalesce(ls, []), lambda l: list_transform(range(1, len(l) + 1), lambda i: {{'w': l[i], 'f': i = 1}}))) AS a FROM src),
        sizes(size, room) AS (VALUES {", ".join(f"({s}, {fitting.capacity(s, 0.5)})" for s in fitting.SIZES)}),
        fold AS (SELECT conv_id, turn, size, room, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS row, CAST(0 AS BIGINT) AS used, '' AS one, '' AS two FROM words, sizes
        UNION ALL SELECT conv_id, turn, size, room, k + 1, row + extra, n_used, CASE WHEN joins AND row = 0 THEN one || ' ' || x.w WHEN NOT joins AND row < 0 THEN substring(x.w, 1, room) ELSE one END,
            CASE WHEN joins AND row = 1 THEN two || ' ' || x.w WHEN NOT joins AND row < 1 AND row + extra >= 1 THEN substring(x.w, CAST((0 - row) * room + 1 AS BIGINT), room) ELSE two END
        FROM (SELECT *, CASE WHEN joins THEN 0 ELSE 1 + (length(x.w) - 1) // room END AS extra, CASE WHEN joins THEN used + 1 + length(x.w) ELSE length(x.w) - (length(x.w) - 1) // room * room END AS n_used
            FROM (SELECT f.*, a[k + 1] AS x, NOT a[k + 1].f AND used + 1 + length(a[k + 1].w) <= room AS joins FROM fold f JOIN words USING (conv_id, turn) WHERE k < len(a)) s) t),
        done AS (SELECT conv_id, turn, size, any_value(room) AS room, arg_max(row, k) + 1 AS n, arg_max(one, k) AS one, arg_max(two, k) AS two FROM fold GROUP BY conv_id, turn, size),
        best AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN n <= {fitting.MOST} THEN -size ELSE size END) = 1)
        SELECT conv_id, turn, CAST(size AS INT) AS size, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN one WHEN n = 2 THEN one || chr(10) || two ELSE one || chr(10) || rtrim(substring(two, 1, room - 1)) || '…' END AS lines FROM best""",
    "subtitle_round_trip": f"""WITH a AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', chr(10), 'g'), chr(10)), lambda l: {_clean_sql('l')}), lambda l: l <> '') AS lines FROM conversations)
        SELECT conv_id, turn * 2.5::DOUBLE AS start, turn * 2.5::DOUBLE + 2 AS "end", array_to_string(lines, chr(10)) AS body FROM a WHERE len(lines) > 0""",
    "probe_json": """WITH a AS (SELECT p_partkey AS p, CAST(round((p_partkey % 1000 + 16) * (p_partkey % 5 + 1)::DOUBLE / 3) AS BIGINT) AS w FROM part)
        SELECT p AS p_partkey, CASE WHEN p % 2 = 1 THEN 480 ELSE w END AS width, CASE WHEN p % 2 = 1 THEN w ELSE 480 END AS height, p + 0.25::DOUBLE AS duration, true AS has_audio, 2 AS n_subtitles, CASE WHEN p % 2 = 0 THEN 0 ELSE 1 END AS text_stream FROM a""",
    "header_bytes": """WITH a AS (SELECT p_partkey, list_transform(range(1, 33), lambda i: ord(substring(rpad(p_name, 32, '~'), i, 1))) AS d FROM part)
        SELECT p_partkey, CAST(((-list_sum(d[1:30]) - 25) % 256 + 256) % 256 AS BIGINT) AS check_byte, CAST(d[3] + d[4] * 256 + d[5] * 65536 + d[6] * 16777216::BIGINT AS BIGINT) AS word, CAST(d[9] + d[10] * 256 AS BIGINT) AS half FROM a""",
} | frame_queries.ORACLE_SQL | codec_queries.ORACLE_SQL
