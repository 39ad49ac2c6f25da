"""First-n samples in a stated order, and positional pairing of two samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: size of the benchmark sample.
SAMPLE_SIZE = 16


def take_first(df: DataFrame, order: str, n: int = SAMPLE_SIZE) -> DataFrame:
    """The first ``n`` rows by ``order`` (a top-n per task, merged; no full sort)."""
    return df.orderBy(order).limit(n)


def zip_pairs(
    queries: DataFrame, texts: DataFrame, query_order: str, text_order: str, n: int = SAMPLE_SIZE
) -> DataFrame:
    """Pair the i-th of the first ``n`` queries with the i-th of the first ``n`` texts.

    Stops at the shorter side. The windows below see at most ``n`` rows.
    """

    def numbered(df: DataFrame, order: str) -> DataFrame:
        return take_first(df, order, n).withColumn(
            "ordinal", F.row_number().over(Window.orderBy(order)).cast("bigint")
        )

    return numbered(queries, query_order).join(numbered(texts, text_order), "ordinal")
