"""What the operators of this subpackage share: tables, text batches, shared folders and run counters."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; bounds the memory of Python workers.
SLICE_BYTES = 4 << 20
#: Used for checkpoints where spark.checkpoint.dir is unset and everything runs in one process (tests, benchmarks).
LOCAL_SHARED = "/tmp/tideline-shared"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors and the driver can open."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str, per_file: int = 0) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later steps never recompute it. per_file: rows of a file at most (0: any), for rows of many bytes, as a file is read in batches of thousands of rows."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text; a longer text comes alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)))
    at, n = 0, len(ends)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total, dtype=np.int64)


def single_thread() -> None:
    """Native libraries inside a task use that task's one core."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
