"""The corpus pipeline: from documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next one's docs. All stages but the last return
the columns of documents. run(spark, sf_dir) applies them to the documents table.

1. quality: documents that the nearest-neighbour classifier scores below 0.3 go. It learns from labels.quality.
2. language: documents without a language (null or letterless text) or with too little evidence for one go: the share
   of their n-grams that the language knows is under a quarter of what nearly all its labelled documents have, or nothing.
3. jaccard: of each class of near-duplicates (five words, 0.8) the document with the smallest doc_id stays.
4. secrets: every span that the rules or the Markov models find is replaced by a mask; n_chars follows.
5. packing: the texts' pieces with their places in sequences of 1024 tokens. Encoding takes little memory, as the
   executors already hold what the stages before left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import jaccard, langid, packing, quality, secrets
from tideline.llm.common import kept, table
from tideline.llm.queries import BYTE_BPE
from tideline.llm.tokens import TIGHT


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return quality.keep(docs, quality.train(docs, labels))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = docs.select("doc_id", "text", "lang")
    return langid.keep(docs, langid.train(labelled), langid.calibrate(labelled))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BYTE_BPE, room=TIGHT)


STAGES = [("quality", keep_good), ("language", keep_known_language), ("jaccard", keep_one_of_each_class), ("secrets", mask_secrets), ("packing", pack)]
#: No SQL form: the first, second, third and fifth stages are models, a similarity join and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
