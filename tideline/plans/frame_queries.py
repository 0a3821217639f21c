"""Registered queries of frames, records and clips, and their DuckDB equivalents; catalog.py takes them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import media
from tideline.operators import frames, ordered
from tideline.operators.ordered import Stream

#: Each vector of 64 numbers stands for a frame of SIDE x SIDE pixels; CLIPS clips take turns.
SIDE, CLIPS = 8, 4
#: Frames of a group, squared distance that sends a block again, the codebook, pixels that are looked at.
GROUP, SKIP, SEEN = 8, 60_000.0, 16
BOOK = [[64.0 * j + 32] * 12 for j in range(4)]
#: A palette; two slots are equal.
PALETTE = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 0), (200, 200, 40), (90, 90, 90), (255, 255, 255)]
#: Entries of a page, widest line of a box, seconds of a clip.
PER_PAGE, WIDEST, WHOLE = 3, 60, 400.0


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, x, y, r, g, b)."""
    rows = _t(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v, i = F.floor(F.col("e").cast("double") * 64).cast("long"), F.col("i")
    colours = [F.pmod(c, F.lit(256)).cast("long").alias(n) for c, n in ((v * 2 + 128, "r"), (v * 3, "g"), (v + i, "b"))]
    return rows.select((F.col("vec_id") % CLIPS).alias("clip"), F.floor(F.col("vec_id") / CLIPS).alias("frame"), (i % SIDE).alias("x"), F.floor(i / SIDE).alias("y"), *colours)


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.encoded(frames.block_vectors(_pixels(spark, sf_dir), ["clip", "frame"]), "clip", "frame", GROUP, BOOK, SKIP)


def frame_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = frames.block_vectors(_pixels(spark, sf_dir), ["clip", "frame"])
    return blocks.select("clip", "frame", "block_x", "block_y", F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ",").alias("v"))


def frame_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("clip", "frame", "block_x", "block_y", "sent", F.col("code").cast("long").alias("code"))


def frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = frames.decoded(_codes(spark, sf_dir), "clip", "frame", GROUP, BOOK)
    return shown.select("clip", "frame", *[F.col(c).cast("long").alias(c) for c in "xyrgb"])


def frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = frames.decoded(_codes(spark, sf_dir), "clip", "frame", GROUP, BOOK)
    got = frames.quality(_pixels(spark, sf_dir), shown, ["clip", "frame"])
    return got.select("clip", "frame", F.round("mse", 3).alias("mse"), F.round("psnr", 3).alias("psnr"))


def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.scene_cuts(_pixels(spark, sf_dir), "clip", "frame", SIDE, SIDE, most=SEEN)


def palette_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.sampled(_pixels(spark, sf_dir), "clip", "frame", SIDE, SIDE, most=500)


def palette_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palette slot of every event's colour; the table of all 15-bit colours has 32768 rows at any size."""
    r, g, b = ((F.col("event_id") * k % 256).cast("int") for k in (7, 13, 29))
    slots = frames.nearest_colours(spark, PALETTE)
    return _t(spark, sf_dir, "events").select("event_id", media.to_555(r, g, b).alias("c555")).join(F.broadcast(slots), "c555").select("event_id", "c555", F.col("slot").cast("int").alias("slot"))


def menu_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.ranked(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), Stream(["p_brand"], ["p_partkey"], "floor(p_partkey / 4096)"))
    return rows.select("p_partkey", "p_brand", F.floor(F.col("rank") / PER_PAGE).alias("page"), (F.col("rank") % PER_PAGE).alias("place"))


def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a brand and size as packed records, unpacked again; a pack is one value, so its records meet in one row."""
    names = F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_name").cast("binary").alias("name"))))
    packs = _t(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(names.alias("names"))
    packs = packs.select("p_brand", "p_size", media.packed(F.transform("names", lambda n: n["name"])).alias("data"))
    rows = packs.select("p_brand", "p_size", F.octet_length("data").cast("long").alias("n_bytes"), F.posexplode(media.unpacked(F.col("data"))).alias("at", "name"))
    return rows.select("p_brand", "p_size", "n_bytes", F.col("at").cast("long").alias("at"), F.col("name").cast("string").alias("name"))


def clip_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = F.floor(F.col("value") * 10).cast("long"), F.col("event_id")

    def written(n: Column, kind: Column) -> Column:
        return F.when(kind == 0, "  ").when(kind == 1, n.cast("string")).when(kind == 2, F.concat(F.floor(n / 60).cast("string"), F.lit(":"), (n % 75).cast("string"))).otherwise("soon")

    t = media.trimmed(written(v % 500, k % 4), written(v % 700, F.floor(k / 4) % 3), F.lit(WHOLE))
    return _t(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", "t.start", "t.end", "t.error")


def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    missing = F.length(F.regexp_replace(body, r"[\x20-\x7e\s]", ""))
    widest = F.array_max(F.transform(F.split(body, "\n", -1), F.length))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", missing.cast("long").alias("missing"), F.least(widest + 2, F.lit(WIDEST)).cast("long").alias("width"))


def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user: rows, bytes of aligned records with their costs, and whether any is a purchase."""
    size = media.aligned(F.length("props")) + 4
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("n_bytes"), F.bool_or(F.col("event_type") == "purchase").alias("any_purchase"))


_ALL = [frame_blocks, frame_codes, frame_pixels, frame_quality, scene_cuts, palette_sample, palette_slots, menu_pages, record_round_trip, clip_trims, text_boxes, user_totals]
QUERIES = {f.__name__: f for f in _ALL}

_PX = f"""raw AS (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    px AS (SELECT vec_id % {CLIPS} AS clip, vec_id // {CLIPS} AS frame, CAST(i % {SIDE} AS INT) AS x, i // {SIDE} AS y, ((v * 2 + 128) % 256 + 256) % 256 AS r, (v * 3 % 256 + 256) % 256 AS g, ((v + i) % 256 + 256) % 256 AS b FROM raw)"""
_BLOCKS = f"{_PX}, blocks AS (SELECT clip, frame, x // 2 AS cx, y // 2 AS cy, flatten(list([r, g, b] ORDER BY y, x)) AS v FROM px GROUP BY ALL)"
_FAR = "list_sum(list_transform(range(1, 13), lambda i: ({a}[i] - {b}) * ({a}[i] - {b})))"
_NEAREST = "CAST(list_position(d, list_min(d)) - 1 AS BIGINT)"
_CODES = f"""{_BLOCKS}, lanes AS (SELECT *, row_number() OVER (PARTITION BY clip, frame // {GROUP}, cx, cy, frame % 2 ORDER BY frame) AS k FROM blocks),
    sends AS (SELECT clip, frame, cx, cy, k, v, v AS held, true AS sent FROM lanes WHERE k = 1
        UNION ALL SELECT l.clip, l.frame, l.cx, l.cy, l.k, l.v, CASE WHEN {_FAR.format(a="l.v", b="s.held[i]")} > {SKIP} THEN l.v ELSE s.held END, {_FAR.format(a="l.v", b="s.held[i]")} > {SKIP}
        FROM sends s JOIN lanes l ON l.clip = s.clip AND l.cx = s.cx AND l.cy = s.cy AND l.k = s.k + 1 AND l.frame // {GROUP} = s.frame // {GROUP} AND l.frame % 2 = s.frame % 2),
    priced AS (SELECT *, [{", ".join(_FAR.format(a="v", b=book[0]) for book in BOOK)}] AS d FROM sends),
    codes AS (SELECT clip, frame, cx, cy, sent, CASE WHEN sent THEN {_NEAREST} END AS code FROM priced)"""
_SHOWN = f"""{_CODES}, pages AS (SELECT clip, frame, cx, cy, last_value(code IGNORE NULLS) OVER (PARTITION BY clip, cx, cy, frame % 2 ORDER BY frame) AS code FROM codes),
    shown AS (SELECT clip, frame, CAST(cx * 2 + j % 2 AS BIGINT) AS x, CAST(cy * 2 + j // 2 AS BIGINT) AS y, CAST(code * 64 + 32 AS BIGINT) AS r, CAST(code * 64 + 32 AS BIGINT) AS g, CAST(code * 64 + 32 AS BIGINT) AS b FROM pages, range(4) t(j))"""
_SLOTS = ", ".join(f"({i}, {r >> 3}, {g >> 3}, {b >> 3}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTE))
_WRITTEN = "CASE {k} WHEN 0 THEN NULL WHEN 1 THEN CAST({n} AS DOUBLE) WHEN 2 THEN CASE WHEN {n} % 75 < 60 THEN CAST({n} // 60 * 60 + {n} % 75 AS DOUBLE) END END"

ORACLE_SQL = {
    "frame_blocks": f"WITH {_BLOCKS} SELECT clip, frame, CAST(cx AS BIGINT) AS block_x, CAST(cy AS BIGINT) AS block_y, array_to_string(v, ',') AS v FROM blocks",
    "frame_codes": f"WITH RECURSIVE {_CODES} SELECT clip, frame, CAST(cx AS BIGINT) AS block_x, CAST(cy AS BIGINT) AS block_y, sent, code FROM codes",
    "frame_pixels": f"WITH RECURSIVE {_SHOWN} SELECT * FROM shown",
    "frame_quality": f"""WITH RECURSIVE {_SHOWN}, m AS (SELECT p.clip, p.frame, sum((p.r - s.r) * (p.r - s.r) + (p.g - s.g) * (p.g - s.g) + (p.b - s.b) * (p.b - s.b))::DOUBLE / (count(*) * 3) AS mse
        FROM px p JOIN shown s ON s.clip = p.clip AND s.frame = p.frame AND s.x = p.x AND s.y = p.y GROUP BY ALL)
        SELECT clip, frame, round(mse, 3) AS mse, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025 / mse) END, 3) AS psnr FROM m""",
    "scene_cuts": f"""WITH {_PX}, seen AS (SELECT * FROM px WHERE (y * {SIDE} + x) % {max(1, SIDE * SIDE // SEEN)} = 0)
        SELECT a.clip, a.frame, sum(abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) // (count(*) * 3) > 40 AS cut FROM seen a JOIN seen b ON b.clip = a.clip AND b.frame = a.frame - 1 AND b.x = a.x AND b.y = a.y GROUP BY a.clip, a.frame""",
    "palette_sample": f"""WITH {_PX}, numbered AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame, y, x) - 1 AS k, count(*) OVER (PARTITION BY clip) AS n FROM px)
        SELECT clip, frame, x, CAST(y AS BIGINT) AS y, r, g, b FROM numbered WHERE k % greatest(n // 500, 1) = 0""",
    "palette_slots": f"""WITH slots(slot, a, b, c, r, g, bl) AS (VALUES {_SLOTS}), colours AS (SELECT CAST(i AS INT) AS c555, i & 31 AS x, (i >> 5) & 31 AS y, (i >> 10) & 31 AS z FROM range(32768) t(i)),
        wide AS (SELECT c555, (x << 3) | (x >> 2) AS x, (y << 3) | (y >> 2) AS y, (z << 3) | (z >> 2) AS z FROM colours),
        best AS (SELECT c555, CAST(arg_min(slot, ((x - r) * (x - r) + (y - g) * (y - g) + (z - bl) * (z - bl), slot)) AS INT) AS slot FROM wide, slots GROUP BY c555)
        SELECT event_id, c555, slot FROM best JOIN (SELECT event_id, CAST((event_id * 7 % 256 >> 3) | ((event_id * 13 % 256 >> 3) << 5) | ((event_id * 29 % 256 >> 3) << 10) AS INT) AS c555 FROM events) USING (c555)""",
    "menu_pages": f"WITH a AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_partkey, p_brand, k // {PER_PAGE} AS page, k % {PER_PAGE} AS place FROM a",
    "record_round_trip": """SELECT p_brand, p_size, CAST(4 + sum(4 + octet_length(encode(p_name))) OVER (PARTITION BY p_brand, p_size) AS BIGINT) AS n_bytes,
        row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS at, p_name AS name FROM part""",
    "clip_trims": f"""WITH a AS (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS v, event_id % 4 AS k, event_id // 4 % 3 AS j FROM events),
        b AS (SELECT event_id, k, j, {_WRITTEN.format(k="k", n="(v % 500)")} AS s, {_WRITTEN.format(k="j", n="(v % 700)")} AS e FROM a),
        c AS (SELECT *, CASE WHEN k <> 0 AND s IS NULL THEN 'start is no time' WHEN j <> 0 AND e IS NULL THEN 'end is no time' WHEN s >= e THEN 'end must be after start' WHEN s >= {WHOLE} THEN 'start is beyond the end of the clip' END AS error FROM b)
        SELECT event_id, CASE WHEN error IS NULL THEN coalesce(s, 0) END AS start, CASE WHEN error IS NULL THEN least(coalesce(e, {WHOLE}), {WHOLE}) END AS "end", error FROM c""",
    "text_boxes": f"""SELECT conv_id, turn, CAST(length(regexp_replace(coalesce(text, ''), '[\\x20-\\x7e\\s]', '', 'g')) AS BIGINT) AS missing,
        CAST(least(list_max(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: length(l))) + 2, {WIDEST}) AS BIGINT) AS width FROM conversations""",
    "user_totals": "SELECT user_id, count(*) AS n, CAST(sum((length(props) + 3) // 4 * 4 + 4) AS BIGINT) AS n_bytes, bool_or(event_type = 'purchase') AS any_purchase FROM events GROUP BY user_id",
}
