"""Timed intervals: cues that don't overlap, clipped to a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Stream, previous


def overlaps_clamped(df: DataFrame, keys: list[str], start: str, end: str, ordinal: str, block: Column) -> DataFrame:
    """Intervals that end where the next one of their key begins at the latest; empty ones go.

    Of intervals with one start, only the last by ordinal remains."""
    after = previous(df.where(F.col(end) > F.col(start)), Stream(keys, [start, ordinal], block), "_next", F.col(start), reverse=True)
    return after.withColumn(end, F.least(F.col(end), F.col("_next"))).where(F.col(end) > F.col(start)).drop("_next")


def clipped(df: DataFrame, start: str, end: str, low: Column | float, high: Column | float) -> DataFrame:
    """The intervals that overlap [low, high), cut to it and counted from its begin; pushed down as two comparisons."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    inside = df.where((F.col(end) > low) & (F.col(start) < high))
    return inside.withColumns({start: F.greatest(F.col(start) - low, F.lit(0)), end: F.least(F.col(end), high) - low})
