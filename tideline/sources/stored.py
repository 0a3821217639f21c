"""Steps that later ones read again, as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where spark.checkpoint.dir is unset and everything runs in one process (tests, benchmarks).
LOCAL_SHARED = "/tmp/tideline-shared"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read again: it is computed once, whatever executors are lost later."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
