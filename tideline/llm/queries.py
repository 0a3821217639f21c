"""The registered queries of this subpackage: one for each numbered operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowout, bpe, jaccard, langid, lexical, lm, media, oddsketch, packing, phrases, quality, secrets, topk
from .common import fold, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4)
    got = langid.predict(docs, langid.train(docs.where(part != 2).select("doc_id", "text", "lang")))
    return got.select("doc_id", (part == 2).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_arrow_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrowout.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE).drop("shard")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lm.score(table(spark, sf_dir, "documents"), BYTE_BPE, fold(F.col("doc_id"), 7) != 2)
    return got.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")).where(part != 0)
    got = quality.predict(docs, quality.train(docs, labels))
    return got.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language, op3_packing, op4_arrow_streams, op5_jaccard, op5_links, op6_lm, op7_media, op8_quality, op9_secrets, op10_topk, op11_phrases, op12_lexical, op13_odd_sketch)}
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _near(words: int, percent: int, more: str = "") -> str:
    """Classes of documents by all pairs that share a shingle."""
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        runs AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END AS s FROM words),
        shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(s) AS s FROM runs),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY x, y),
        links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
        both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other)
        SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(other), d.doc_id) AS component_id{more} FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id"""


#: The joins have DuckDB forms: all pairs by shared shingles, all products, all scores. Models, tokenizers and media have none.
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard": _near(jaccard.WORDS, jaccard.PERCENT),
    "op13_odd_sketch": _near(oddsketch.WORDS, oddsketch.PERCENT, ", coalesce(min(other), d.doc_id) = d.doc_id AS kept"),
    "op10_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scored AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 20""",
    "op11_phrases": f"""WITH RECURSIVE pieces AS (SELECT row_number() OVER () AS p, lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM
            (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)) WHERE len(w) > 0),
        n AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
        grams AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM pieces, range(1, {phrases.LONGEST + 1}) s(size)))
            GROUP BY lang, phrase, size HAVING count(*) >= {phrases.MIN}),
        cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1),
        inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(range(1, c.size - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS phrase FROM cand c, range(2, {phrases.LONGEST}) t(s) WHERE s < c.size) GROUP BY lang, phrase),
        own AS (SELECT c.* FROM cand c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < 100 * a),
        cuts AS (SELECT o.lang, o.phrase, o.a, k, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * o.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM own o JOIN range(1, {phrases.LONGEST}) t(k) ON k < o.size
            JOIN grams l ON l.lang = o.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN grams r ON r.lang = o.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN n ON n.lang = o.lang),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM lowest WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER best <= {phrases.TOP}""",
    "op12_lexical": f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents), docs AS (SELECT *, len(t) AS n FROM d WHERE len(t) > 0),
        tot AS (SELECT count(*) AS nn, sum(n) AS ll FROM docs), items AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        tf AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY k, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term),
        m AS (SELECT k, doc_id, CAST(50 + (50 * n * nn) // ll AS BIGINT) AS m FROM docs, tot),
        scored AS (SELECT item_id, k, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM items JOIN tf USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY item_id, k)
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= {lexical.K}""",
}
