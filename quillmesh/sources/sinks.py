"""Sinks: result tables, evaluation reports, benchmark results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, mode: str = "error") -> None:
    """Embeddings (array + map) or scores as Parquet."""
    df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, mode: str = "error") -> DataFrame:
    """Results as a table ``name`` at ``path``, dealt into buckets by ``keys`` and sorted, one file per bucket.

    Tables with the same buckets are aligned without a shuffle. ``open_bucketed`` makes the table known to another session.
    """
    dealt = df.repartition(buckets, *keys).write.format("parquet").mode(mode).option("path", path)
    dealt.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table of ``write_bucketed`` in a session that does not know it yet."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def write_evaluation(report: DataFrame, samples: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """Report lines under ``<path>/report`` and per-sample metrics under ``<path>/<name>``.

    Samples are written by the tasks that made them; nothing passes through the driver.
    """
    lines = report.orderBy("line_no").select(F.col("line").alias("value"))
    lines.coalesce(1).write.mode(mode).text(f"{path}/report")
    for name, df in samples.items():
        df.write.mode(mode).json(f"{path}/{name}")


def write_benchmark(stats: DataFrame, log: DataFrame, config: dict[str, str], path: str, mode: str = "error") -> None:
    """Statistics with the run configuration and a time stamp, and the raw latencies as a table."""
    settings = F.create_map(*[F.lit(str(x)) for pair in sorted(config.items()) for x in pair])
    stamped = stats.withColumns({"config": settings, "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")})
    stamped.write.mode(mode).json(f"{path}/stats")
    log.write.mode(mode).json(f"{path}/latencies")
