"""Places of rows in an order, without bringing a key's rows together in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators.skew import same_key_join
from quillmesh.session import materialize

_INSIDE = (1 << 33) - 1


def place_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``, the 0-based place of a row among the rows of its keys by ``order`` (NULLs first).

    Rows are sorted in ranges over all tasks, so a key of any size is cut where the ranges are. Only the number of rows per key
    and range is added up: as many rows as there are keys, and one more per border.
    """
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    row = F.monotonically_increasing_id()
    stored = materialize(sorted_.withColumn("_row", row), "ordered")
    stored = stored.withColumns({"_part": F.shiftright("_row", 33), "_inside": F.col("_row").bitwiseAND(F.lit(_INSIDE))})
    pieces = stored.groupBy(*keys, "_part").agg(F.min("_inside").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = same_key_join(stored, pieces, [*keys, "_part"])
    return placed.withColumn(out, F.col("_inside") - F.col("_first") + F.col("_before")).select(*df.columns, out)
