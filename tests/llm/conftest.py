import zlib

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def sf_more():
    """The smallest tables hold no secrets; these do."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


#: Nulls in any column, empty and odd texts, ties and repeated rows.
ODD = [
    (None, None, None, None, None),
    (1, None, "en", "s", 0),
    (2, "", None, None, None),
    (3, "   \n\t ", "en", "s", 5),
    (4, "12 345 !?", "de", "s", 9),
    (5, "<|endoftext|> a<|startoftext|>b  c", "en", "s", 3),
    (6, "é éÉ İ Σσς ẞ it's we'll  x y\x00z\x1cq ﬁ \U0001f600‍", "en", "s", 3),
    (7, "one two three four five six", "en", "s", 3),
    (8, "ONE two three four five six", "en", "s", 3),
    (9, "one two", "en", "s", 3),
    (9, "one two", "en", "s", 3),
    (10, "a a a a a a a a a a", "en", "s", 3),
    (11, "w" * 70_000, "en", "s", 3),
    (12, "word again and so on " * 20_000, "en", "s", 3),
    (None, "no id", "en", "s", 3),
]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """Tables with odd rows and columns whose names clash with those of the operators."""
    top = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.select("*", *[F.lit(7).alias(c) for c in ("score", "ids", "slice", "length", "bucket", "set_id", "label", "sigs", "learn", "rank", "spans", "terms", "n_tokens", "piece", "members")])
    extra.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (7, 1, 0), (10, 0, 0), (8, 5, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    items = [(1, "one two word again 12"), (1, "six SEVEN"), (2, None), (3, "..."), (None, "so on é a"), (4, "a " * 500)]
    spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("score"), F.lit(2).alias("block")).write.parquet(f"{top}/benchmark.parquet")
    vectors = [(None, [1.0, 2.0]), (0, [0.5, -0.25]), (20, [0.5, -0.25]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (40, [-1.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("score"), F.lit(2).alias("rank"), F.lit("x").alias("pivot")).write.parquet(f"{top}/embeddings.parquet")
    return str(top)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.fixture(scope="session")
def odd_texts():
    return [(d, t) for d, t, *_ in ODD]


def folded(doc_id, n):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % n
