"""Rows in ascending key order over bounded buckets, for operators that need a row's place or its successor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Ascending lower bounds of key ranges with about equally many rows; only the key column is read.

    Their number depends on ``buckets`` alone, never on the data.
    """
    if buckets < 2:
        return []
    cuts = df.select(key).approxQuantile(key, [i / buckets for i in range(1, buckets)], min(0.01, 0.25 / buckets))
    return sorted({int(x) for x in cuts})


def bucket_of(key: Column, bounds: list[int], base: int = 0) -> Column:
    """Number of bounds at or below the key, by binary search over literals; null keys have bucket 0."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    above, below = bucket_of(key, bounds[mid + 1 :], base + mid + 1), bucket_of(key, bounds[:mid], base)
    return F.when(key >= bounds[mid], above).otherwise(below)
