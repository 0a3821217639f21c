"""Deterministic k-means and nearest-centroid quantisation in DataFrame expressions.

Centroids are few (k is a parameter) and travel as one literal array; every row finds its nearest by an expression,
and an iteration is one aggregation with map-side partial sums. The only rows that reach the driver are the centroids. Many
small fits at once, one for each key, are one shuffle: grouped_kmeans().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Stream, ranked


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def nearest(vector: Column, centroids: list[list[float]]) -> Column:
    """Index of the nearest centroid; of equally near ones the lowest."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centroids])
    far = F.transform(table, lambda c, i: F.struct(squared_distance(vector, c).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def seeds(df: DataFrame, vector: str, ordinal: str, k: int, blocks: int = 256) -> list[list[float]]:
    """The vectors at the middles of k equal parts of the rows in order of component sum (then ordinal).

    Ranks come block by block, with blocks at approximate quantiles of the sum: no task sees all rows."""
    rows = df.select(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x).alias("_sum"), F.col(ordinal).alias("_ord"), F.col(vector).alias("_v"))
    n = rows.count()
    k = min(k, n)
    if not k:
        return []
    edges = rows.agg(F.percentile_approx("_sum", [i / blocks for i in range(1, blocks)], 10_000)).first()[0]
    block = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col("_sum")))
    wanted = [(2 * j + 1) * n // (2 * k) for j in range(k)]
    placed = ranked(rows.withColumn("_all", F.lit(0)), Stream(["_all"], ["_sum", "_ord"], block), "_rank").where(F.col("_rank").isin(wanted))
    return [list(r["_v"]) for r in sorted(placed.select("_rank", "_v").collect(), key=lambda r: r["_rank"])]  # k rows


def kmeans(df: DataFrame, vector: str, ordinal: str, k: int, iterations: int) -> list[list[float]]:
    """Centroids after a fixed number of rounds; a centroid without rows stays where it is."""
    centroids = [[float(x) for x in c] for c in seeds(df, vector, ordinal, k)]
    for _ in range(iterations if centroids else 0):
        found = df.groupBy(nearest(F.col(vector), centroids).alias("c")).agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"x{i}") for i in range(len(centroids[0]))])
        for r in found.collect():  # k rows
            centroids[r["c"]] = [r[f"x{i}"] for i in range(len(centroids[0]))]
    return centroids


def codebook(df: DataFrame, vector: str, ordinal: str, k: int, iterations: int, quantise: Column | None = None) -> DataFrame:
    """(code, entry): the distinct quantised centroids in lexicographic order. quantise: of a column `entry`."""
    found = df.sparkSession.createDataFrame([(c,) for c in kmeans(df, vector, ordinal, k, iterations)], "entry array<double>")
    entries = found.select((quantise if quantise is not None else F.transform("entry", lambda x: F.floor(x))).alias("entry")).distinct()
    return entries.withColumn("code", F.row_number().over(Window.orderBy("entry")) - 1)  # k rows at most


def nearest_of(x: np.ndarray, centres: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Index of the nearest centre (k, d) of each row (n, d); of equally near ones the lowest. Distances add up component by component."""
    out = np.zeros(len(x), np.int64)
    step = max(1, at_once // max(1, len(centres)))
    for a in range(0, len(x) if len(centres) else 0, step):
        part = x[a : a + step]
        far = np.zeros((len(part), len(centres)))
        for d in range(x.shape[1]):
            far += (part[:, d, None] - centres[None, :, d]) ** 2
        out[a : a + step] = far.argmin(1)
    return out


def fitted(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres (k or fewer, d) of the rows of one task: seeds at the middles of k equal parts in order of component sum, then rounds of means."""
    n = len(x)
    k = min(k, n)
    if not k:
        return np.zeros((0, x.shape[1]))
    centres = x[np.argsort(x.sum(1), kind="stable")[(2 * np.arange(k) + 1) * n // (2 * k)]]
    unique, weight = np.unique(x, axis=0, return_counts=True)  # equal rows move together
    for _ in range(rounds):
        own = nearest_of(unique, centres)
        size = np.bincount(own, weights=weight, minlength=k)
        sums = np.stack([np.bincount(own, weights=weight * unique[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def grouped_kmeans(df: DataFrame, keys: list[str], vector: str, order: list[str], k: int, rounds: int) -> DataFrame:
    """(keys, centre, v array<double>): k centres or fewer for each key, all keys in one pass.

    A key's vectors are fitted in one task, so they should be bounded (samples of bounded groups); kmeans() is for tables. Ties of seeds go by `order`. Null vectors count for nothing."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        centres = fitted(np.array(rows["_v"].to_pylist(), np.float64), k, rounds)
        columns = [pa.array([x.as_py()] * len(centres), x.type) for x in key]
        return pa.table([*columns, pa.array(np.arange(len(centres))), pa.array(centres.tolist(), pa.list_(pa.float64()))], [*keys, "centre", "v"])

    rows = df.where(F.col(vector).isNotNull()).select(*keys, *order, F.col(vector).cast("array<double>").alias("_v"))
    return rows.groupBy(*keys).applyInArrow(work, f"{kinds}, centre long, v array<double>")
