"""Serving and metrics as streaming queries.

Serving is stateless: validation, routing and the model run row by row, so answers do not depend on
how arrivals are batched. The trigger takes the place of a batching policy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.latency import LABELS, latency_histogram, request_counter
from quillmesh.operators.runners import ModelRegistry
from quillmesh.plans.serving import serve_embed, serve_rerank, serve_rewrite


def embed_stream(requests: DataFrame, registry: ModelRegistry, spread: int | None = None) -> DataFrame:
    """One answer row per request, results as arrays in input order.

    ``spread`` deals each micro-batch over that many tasks, for arrivals in a few large files.
    """
    return serve_embed(_dealt(requests, spread), registry, layout="requests")


def rerank_stream(requests: DataFrame, registry: ModelRegistry, spread: int | None = None) -> DataFrame:
    """One row per text of a request, with its position."""
    return serve_rerank(_dealt(requests, spread), registry)


def rewrite_stream(requests: DataFrame, registry: ModelRegistry, spread: int | None = None) -> DataFrame:
    """One row per dialogue of a request, with its position."""
    return serve_rewrite(_dealt(requests, spread), registry)


def _dealt(requests: DataFrame, spread: int | None) -> DataFrame:
    return requests.repartition(spread) if spread else requests


def metrics_stream(log: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Running request counter; state is one row per label combination."""
    return request_counter(log, labels)


def histogram_stream(log: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Running latency histogram over the same log; state is one row per label combination."""
    return latency_histogram(log, labels)


def start_append(df: DataFrame, path: str, checkpoint: str, processing_time: str | None = None) -> StreamingQuery:
    """Append answers to Parquet (exactly once). Without an interval: all available input, then stop."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return writer.trigger(**trigger).start(path)


def start_snapshot(df: DataFrame, path: str, checkpoint: str, processing_time: str | None = None) -> StreamingQuery:
    """Rewrite the complete small aggregate after each micro-batch.

    Two slots take turns, so that one complete state is always there and storage stays bounded.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        stamped = batch.withColumn("epoch", F.lit(epoch).cast("bigint"))
        stamped.write.mode("overwrite").parquet(f"{path}/slot={epoch % 2}")

    writer = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The state after the newest micro-batch."""
    slots = spark.read.parquet(path)
    newest = slots.agg(F.max("epoch").alias("e")).scalar()
    return slots.where(F.col("epoch") == newest).drop("epoch", "slot")
