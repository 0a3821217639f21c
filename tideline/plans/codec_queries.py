"""Registered queries of packed frames, their records and the quality ladder over real bytes, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import cluster, codec, frames, ladder, packed
from tideline.plans import frame_queries
from tideline.plans.frame_queries import _PX, CLIPS, SIDE
from tideline.sources import cartridge
from tideline.sources.stored import shared_path, stored

#: Frames of a group at most, mean change that is a scene cut, palette entries, codebook entries, squared distance that sends a block again.
LONGEST, CHANGE, COLOURS, CODEBOOK, SKIP = 6, 57, 8, 5, 90_000.0
#: Scale of a view, of 256.
ZOOM = 390
#: Frames a second of the clips; quality steps, best first; bytes that a cartridge may have for each frame of all clips.
SOURCE_FPS, PER_FRAME = 20, 14
LADDER = [ladder.Step(20, 8, 20_000.0), ladder.Step(15, 6, 60_000.0), ladder.Step(10, 4, 110_000.0), ladder.Step(5, 2, 300_000.0)]


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, rgb): each vector of 64 numbers is a frame of SIDE x SIDE pixels; CLIPS clips take turns."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null and embedding is not null")

    def pixel(e, i):  # noqa: ANN001, ANN202
        v = F.floor(e.cast("double") * 64).cast("long")
        return F.concat(*[F.lpad(F.hex(F.pmod(c, F.lit(256)).cast("long")), 2, "0") for c in (v * 2 + 128, v * 3, v + i)])

    rgb = F.unhex(F.array_join(F.transform("embedding", pixel), ""))
    return rows.select((F.col("vec_id") % CLIPS).alias("clip"), F.floor(F.col("vec_id") / CLIPS).alias("frame"), rgb.alias("rgb"))


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.grouped(_frames(spark, sf_dir), "clip", "frame", SIDE, SIDE, LONGEST, limit=CHANGE)


def _in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).join(_grouped(spark, sf_dir), ["clip", "frame"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encoded(_in_groups(spark, sf_dir), "clip", "group", "place", SIDE, SIDE, CODEBOOK, SKIP, carry=["frame"], colours=COLOURS)


def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed.block_rows(_frames(spark, sf_dir), ["clip", "frame"], SIDE, SIDE)
    return rows.select("clip", "frame", "block_x", "block_y", F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ",").alias("v"))


def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir).select("clip", "frame", "cut", "group", "place")


def group_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of the pixels of every group, all groups in one pass, as 15-bit colours."""
    rows = _in_groups(spark, sf_dir).select("clip", "group", "place", F.posexplode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i", "_"), "rgb")
    colour = F.array(*[F.conv(F.hex(F.substring("rgb", F.col("i") * 3 + 1 + c, F.lit(1))), 16, 10).cast("double") for c in range(3)])
    found = cluster.grouped_kmeans(rows.select("clip", "group", "place", "i", colour.alias("v")), ["clip", "group"], "v", ["place", "i"], COLOURS - 1, codec.PALETTE_ROUNDS)
    word = sum((F.floor(F.floor(F.get("v", F.lit(c)) + 0.5) / 8) * (1 << 5 * c) for c in range(3)), F.lit(0))
    return found.select("clip", "group", "centre", word.cast("long").alias("c555"))


def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("clip", "frame", F.hex("record").alias("record"))


def record_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that each record sends, read from its bytes."""
    return codec.op_rows(_records(spark, sf_dir), ["clip", "frame"], SIDE * SIDE // 4, colours=COLOURS).where("error is null").select("clip", "frame", "block", "code")


def shown_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decibels of the frames that the records show, against the frames."""
    shown = codec.decoded(_records(spark, sf_dir), "clip", "group", "place", SIDE, SIDE, carry=["frame"], colours=COLOURS).select("clip", "frame", F.col("rgb").alias("shown"))
    both = packed.compared(_frames(spark, sf_dir).join(shown, ["clip", "frame"]), ["clip", "frame"], "rgb", "shown")
    return both.select("clip", "frame", F.round("mse", 3).alias("mse"), F.round(frames.psnr(F.col("mse")), 3).alias("psnr"))


def zoomed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames through an affine view, half again as large and moved, of which parts lie outside."""
    seen = packed.viewed(_frames(spark, sf_dir), ["clip", "frame"], SIDE, SIDE, 6, 5, ZOOM, -300, 200)
    return seen.select("clip", "frame", F.hex("rgb").alias("rgb"))


def ladder_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first quality step whose records fit a cartridge of two clips."""
    clips = _frames(spark, sf_dir).withColumn("cart", F.floor(F.col("clip") / 2))

    def encode(rows: DataFrame, step: ladder.Step) -> DataFrame:
        shown = ladder.at_rate(rows, "frame", SOURCE_FPS, step.fps)
        placed = shown.join(packed.grouped(shown, "clip", "frame", SIDE, SIDE, LONGEST, limit=CHANGE), ["clip", "frame"])
        return codec.encoded(placed, "clip", "group", "place", SIDE, SIDE, step.codebook, step.skip, carry=["cart", "frame"], colours=COLOURS)

    return ladder.searched(clips, ["cart"], "clip", "frame", LADDER, encode, PER_FRAME * clips.count())[0]


_ALL = [packed_blocks, frame_groups, group_palettes, frame_records, record_blocks, shown_quality, zoomed_frames, ladder_records]
QUERIES = {f.__name__: f for f in _ALL}

_GROUP_TABLES = f"""fr AS (SELECT clip, frame, lag(frame) OVER (PARTITION BY clip ORDER BY frame) AS p, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS k FROM (SELECT DISTINCT clip, frame FROM px)),
    cuts AS (SELECT f.clip, f.frame, any_value(f.k) AS k, coalesce(sum(abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) // (count(*) * 3) > {CHANGE}, false) AS cut
        FROM fr f JOIN px a ON a.clip = f.clip AND a.frame = f.frame LEFT JOIN px b ON b.clip = f.clip AND b.frame = f.p AND b.x = a.x AND b.y = a.y GROUP BY f.clip, f.frame),
    scenes AS (SELECT *, (k - max(CASE WHEN cut OR k = 0 THEN k END) OVER (PARTITION BY clip ORDER BY k)) % {LONGEST} AS place FROM cuts),
    gr AS MATERIALIZED (SELECT clip, frame, cut, CAST(sum(CASE WHEN place = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY k) AS BIGINT) - 1 AS grp, place FROM scenes)"""
_GROUPS = f"{_PX}, {_GROUP_TABLES}"


def _fits(name: str, keys: str, points: str, dims: int, k: int, rounds: int) -> str:
    """Common table expressions {name}0 .. (keys, c, v): centres of points (keys, ord, v) of each key."""
    far = " + ".join(f"(p.v[{i}] - q.v[{i}]) * (p.v[{i}] - q.v[{i}])" for i in range(1, dims + 1))
    means = ", ".join(f"sum(v[{i}])::DOUBLE / count(*)" for i in range(1, dims + 1))
    parts = [
        f"{name}pts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY list_sum(v), ord) - 1 AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {points})",
        f"{name}0 AS MATERIALIZED (SELECT {keys}, j AS c, list_transform(v, lambda x: x::DOUBLE) AS v FROM {name}pts, range({k}) t(j) WHERE j < least({k}, n) AND r = (2 * j + 1) * n // (2 * least({k}, n)))",
    ]
    for t in range(rounds):
        parts += [
            f"{name}n{t} AS MATERIALIZED (SELECT {keys}, r, any_value(p.v) AS v, arg_min(c, {{'d': {far}, 'c': c}}) AS c FROM {name}pts p JOIN {name}{t} q USING ({keys}) GROUP BY {keys}, r)",
            f"{name}{t + 1} AS MATERIALIZED (SELECT {keys}, c, coalesce(m.v, o.v) AS v FROM {name}{t} o LEFT JOIN (SELECT {keys}, c, [{means}] AS v FROM {name}n{t} GROUP BY {keys}, c) m USING ({keys}, c))",
        ]
    return ", ".join(parts)


def _word(r: str, g: str, b: str) -> str:
    return "(" + " | ".join(f"((CAST(least(greatest(floor({c} + 0.5), 0), 255) AS INT) >> 3) << {5 * i})" for i, c in enumerate((r, g, b))) + ")"


def _wide(word: str, i: int) -> str:
    five = f"(({word} >> {5 * i}) & 31)"
    return f"(({five} << 3) | ({five} >> 2))"


_PALETTE_TABLES = f"""colour AS (SELECT clip, grp, place * {SIDE * SIDE} + y * {SIDE} + x AS ord, [r, g, b] AS v FROM px JOIN gr USING (clip, frame)),
    {_fits("pal", "clip, grp", "colour", 3, COLOURS - 1, codec.PALETTE_ROUNDS)}"""
_PALETTES = f"{_GROUPS}, {_PALETTE_TABLES}"
_LAST = f"pal{codec.PALETTE_ROUNDS}"
_HELD_FAR = " + ".join(f"(l.v[{i}] - s.held[{i}]) * (l.v[{i}] - s.held[{i}])" for i in range(1, 13))


def _coded(codebook: int, skip: float) -> str:
    return f"""slots AS MATERIALIZED (SELECT clip, grp, slot, w, [{", ".join(_wide("w", i) for i in range(3))}] AS c FROM
        (SELECT clip, grp, CAST(c + 1 AS BIGINT) AS slot, {_word("v[1]", "v[2]", "v[3]")} AS w FROM {_LAST} UNION ALL SELECT DISTINCT clip, grp, 0, 0 FROM gr)),
    blk AS MATERIALIZED (SELECT clip, grp, place, frame, (y // 2) * {SIDE // 2} + x // 2 AS ord, flatten(list([r, g, b] ORDER BY y, x)) AS v FROM px JOIN gr USING (clip, frame) GROUP BY ALL),
    sends AS (SELECT clip, grp, place, ord, v, v AS held, true AS sent FROM blk WHERE place < 2
        UNION ALL SELECT l.clip, l.grp, l.place, l.ord, l.v, CASE WHEN {_HELD_FAR} > {skip} THEN l.v ELSE s.held END, {_HELD_FAR} > {skip} FROM sends s JOIN blk l ON l.clip = s.clip AND l.grp = s.grp AND l.ord = s.ord AND l.place = s.place + 2),
    train AS MATERIALIZED (SELECT clip, grp, place, ord, v FROM sends WHERE sent), {_fits("cb", "clip, grp, place", "train", 12, codebook, codec.CODEBOOK_ROUNDS)},
    quads AS (SELECT clip, grp, place, c, p, {_word("v[p * 3 + 1]", "v[p * 3 + 2]", "v[p * 3 + 3]")} AS w FROM cb{codec.CODEBOOK_ROUNDS}, range(4) t(p)),
    wide AS (SELECT *, [{", ".join(_wide("w", i) for i in range(3))}] AS x FROM quads),
    quad AS (SELECT clip, grp, place, wide.c, p, arg_min(slot, {{'d': {" + ".join(f"(x[{i}] - s.c[{i}]) * (x[{i}] - s.c[{i}])" for i in (1, 2, 3))}, 's': slot}}) AS slot FROM wide JOIN slots s USING (clip, grp) GROUP BY clip, grp, place, wide.c, p),
    book AS MATERIALIZED (SELECT clip, grp, place, e, row_number() OVER (PARTITION BY clip, grp, place ORDER BY e) - 1 AS code FROM (SELECT DISTINCT clip, grp, place, e FROM (SELECT clip, grp, place, c, list(slot ORDER BY p) AS e FROM quad GROUP BY clip, grp, place, c))),
    entry AS MATERIALIZED (SELECT clip, grp, place, code, flatten(list(c ORDER BY p)) AS v FROM (SELECT b.clip, b.grp, b.place, code, p, s.c FROM book b, range(4) t(p), slots s WHERE s.clip = b.clip AND s.grp = b.grp AND s.slot = b.e[p + 1]) GROUP BY clip, grp, place, code),
    codes AS MATERIALIZED (SELECT clip, grp, place, ord, arg_min(code, {{'d': {" + ".join(f"(p.v[{i}] - q.v[{i}]) * (p.v[{i}] - q.v[{i}])" for i in range(1, 13))}, 'c': code}}) AS code FROM train p JOIN entry q USING (clip, grp, place) GROUP BY clip, grp, place, ord)"""


_CODED = f"{_PALETTES}, {_coded(CODEBOOK, SKIP)}"
_RECORD_TABLES = f"""marked AS (SELECT b.clip, b.grp, b.place, b.frame, b.ord, code, coalesce((code IS NULL) <> (lag(code) OVER w IS NULL) OR b.ord = 0, true) AS fresh FROM blk b LEFT JOIN codes USING (clip, grp, place, ord) WINDOW w AS (PARTITION BY b.clip, b.grp, b.place ORDER BY b.ord)),
    runs AS (SELECT *, max(CASE WHEN fresh THEN ord END) OVER (PARTITION BY clip, grp, place ORDER BY ord) AS begun FROM marked),
    ops AS (SELECT clip, grp, place, frame, begun, (ord - begun) // 128 AS part, CASE WHEN any_value(code) IS NULL THEN printf('%02X', CAST(count(*) - 1 AS INT)) ELSE printf('%02X', CAST(count(*) + 127 AS INT)) || string_agg(printf('%02X', CAST(code AS INT)), '' ORDER BY ord) END AS h FROM runs GROUP BY ALL),
    body AS (SELECT clip, grp, place, frame, string_agg(h, '' ORDER BY begun, part) AS h FROM ops GROUP BY ALL),
    bookhex AS (SELECT clip, grp, place, count(*) AS n, string_agg(array_to_string(list_transform(e, lambda x: printf('%02X', CAST(x AS INT))), ''), '' ORDER BY code) AS h FROM book GROUP BY ALL),
    palhex AS (SELECT clip, grp, string_agg(printf('%02X%02X', CAST(w & 255 AS INT), CAST(w >> 8 AS INT)), '' ORDER BY slot) AS h FROM slots GROUP BY ALL),
    whole AS (SELECT b.clip, b.frame, printf('%02X00%02X%02X', CAST((b.place < 2)::INT + 2 * (b.place = 0)::INT AS INT), CAST(coalesce(k.n, 0) % 256 AS INT), CAST(coalesce(k.n, 0) // 256 AS INT)) || CASE WHEN b.place = 0 THEN p.h ELSE '' END || coalesce(k.h, '') || b.h AS h
        FROM body b JOIN palhex p USING (clip, grp) LEFT JOIN bookhex k ON k.clip = b.clip AND k.grp = b.grp AND k.place = b.place)"""
_RECORDS = f"{_CODED}, {_RECORD_TABLES}"


def _ladder_sql() -> str:
    """Every step of every cartridge by whole records, then the first that fits."""
    parts = []
    for i, step in enumerate(LADDER):
        px = f"{_PX}".replace(" px AS (", " px0 AS (") + f", px AS (SELECT clip, CAST(ceil(frame * {step.fps} / {SOURCE_FPS}) AS BIGINT) AS frame, x, y, r, g, b FROM px0 WHERE CAST(ceil(frame * {step.fps} / {SOURCE_FPS}) AS BIGINT) * {SOURCE_FPS} // {step.fps} = frame)"
        body = f"WITH RECURSIVE {px}, {_GROUP_TABLES}, {_PALETTE_TABLES}, {_coded(step.codebook, step.skip)}, {_RECORD_TABLES}"
        parts.append(f"SELECT {i} AS step_no, {step.fps} AS fps, clip // 2 AS cart, clip, frame, (length(h) + 7) // 8 * 4 + 4 AS cost FROM ({body} SELECT clip, frame, h FROM whole)")
    return f"""WITH costs AS ({" UNION ALL ".join(parts)}), held AS (SELECT *, sum(cost) OVER (PARTITION BY step_no, cart ORDER BY clip, frame) AS used FROM costs),
        tot AS (SELECT cart, step_no, any_value(fps) AS fps, sum(cost) AS n_bytes, count(*) FILTER (used <= limits) AS n FROM (SELECT *, {{limit}} AS limits FROM held) GROUP BY cart, step_no)
        SELECT cart, CAST(min(step_no) FILTER (n_bytes <= {{limit}}) AS INT) AS step_no, CAST(arg_min(n_bytes, step_no) FILTER (n_bytes <= {{limit}}) AS BIGINT) AS n_bytes,
        CASE WHEN min(step_no) FILTER (n_bytes <= {{limit}}) IS NULL THEN max(n / fps) END AS best_secs FROM tot GROUP BY cart""".replace("{limit}", f"(SELECT {PER_FRAME} * count(*) FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)")


ORACLE_SQL = {
    "ladder_records": _ladder_sql(),
    "packed_blocks": frame_queries.ORACLE_SQL["frame_blocks"],
    "frame_groups": f'WITH {_GROUPS} SELECT clip, frame, cut, grp AS "group", place FROM gr',
    "group_palettes": f'WITH {_PALETTES} SELECT clip, grp AS "group", c AS centre, CAST({_word("v[1]", "v[2]", "v[3]")} AS BIGINT) AS c555 FROM {_LAST}',
    "frame_records": f"WITH RECURSIVE {_RECORDS} SELECT clip, frame, rpad(h, CAST((length(h) + 7) // 8 * 8 AS INT), '0') AS record FROM whole",
    "record_blocks": f"WITH RECURSIVE {_CODED} SELECT clip, frame, CAST(ord AS BIGINT) AS block, code FROM codes JOIN gr USING (clip, grp, place)",
    "shown_quality": f"""WITH RECURSIVE {_CODED}, pages AS (SELECT b.clip, b.grp, b.place, b.frame, b.ord, b.v, last_value(e.v IGNORE NULLS) OVER (PARTITION BY b.clip, b.grp, b.ord, b.place % 2 ORDER BY b.place) AS s
            FROM blk b LEFT JOIN codes c USING (clip, grp, place, ord) LEFT JOIN entry e ON e.clip = b.clip AND e.grp = b.grp AND e.place = b.place AND e.code = c.code),
        m AS (SELECT clip, frame, sum({" + ".join(f"(v[{i}] - s[{i}]) * (v[{i}] - s[{i}])" for i in range(1, 13))})::DOUBLE / {SIDE * SIDE * 3} AS mse FROM pages GROUP BY clip, frame)
        SELECT clip, frame, round(mse, 3) AS mse, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025 / mse) END, 3) AS psnr FROM m""",
    "zoomed_frames": f"""WITH {_PX}, fr AS (SELECT DISTINCT clip, frame FROM px), view AS (SELECT clip, frame, i, j, (-300 + {ZOOM} * i) >> 8 AS x, (200 + {ZOOM} * j) >> 8 AS y FROM fr, range(6) a(i), range(5) b(j))
        SELECT v.clip, v.frame, string_agg(printf('%02X%02X%02X', CAST(coalesce(r, 0) AS INT), CAST(coalesce(g, 0) AS INT), CAST(coalesce(b, 0) AS INT)), '' ORDER BY j, i) AS rgb
        FROM (SELECT clip, frame, i, j, CASE WHEN -300 + {ZOOM} * i < 0 THEN -1 ELSE (-300 + {ZOOM} * i) // 256 END AS x, (200 + {ZOOM} * j) // 256 AS y FROM view) v LEFT JOIN px p ON p.clip = v.clip AND p.frame = v.frame AND p.x = v.x AND p.y = v.y GROUP BY v.clip, v.frame""",
}


def cartridge_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as cartridges of two clips, written as files, and read back from their offset tables."""
    spark.dataSource.register(cartridge.Cartridges)
    records = _records(spark, sf_dir).select((F.floor(F.col("clip") / 2)).alias("cart"), (F.col("clip") % 2).cast("int").alias("video"), F.lit("frame").alias("kind"), F.col("frame").alias("no"), F.col("record").alias("data"))
    records = stored(records, "cartridge-records")
    videos = records.select("cart", "video").distinct().select("cart", "video", F.lit("video").alias("kind"), F.lit(0).cast("long").alias("no"), F.lit(None).cast("binary").alias("data"))
    numbers = [F.lit(n).cast("int").alias(c) for c, n in (("fps", SOURCE_FPS), ("w", SIDE), ("h", SIDE), ("x_off", 0), ("y_off", 0))]
    parts = videos.union(records).select("*", *numbers, F.lit(False).alias("half_res"), F.lit(0).cast("long").alias("samples"), F.concat(F.lit("cart "), F.col("cart").cast("string")).alias("title"))
    images = cartridge.assembled(parts, "cart", "title")
    folder = shared_path(spark, "cartridges").removeprefix("file://")
    images.select(F.concat(F.lit("cart-"), F.col("cart").cast("string"), F.lit(".bin")).alias("name"), "image").write.format("cartridges").mode("append").save(folder)
    back = spark.read.format("cartridges").option("section", "frames").load(folder)
    return back.select(F.regexp_extract("path", r"cart-(\d+)\.bin$", 1).cast("long").alias("cart"), "video", "frame", F.hex("record").alias("record"))


QUERIES["cartridge_round_trip"] = cartridge_round_trip
ORACLE_SQL["cartridge_round_trip"] = f"WITH RECURSIVE {_RECORDS} SELECT clip // 2 AS cart, CAST(clip % 2 AS INT) AS video, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS frame, rpad(h, CAST((length(h) + 7) // 8 * 8 AS INT), '0') AS record FROM whole"
