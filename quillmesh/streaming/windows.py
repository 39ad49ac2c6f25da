"""Service metrics per minute from a stream: event-time windows, a watermark, and a rule for late rows.

A row is late if its event time lies more than ``lateness`` before its arrival. The rule looks at the row alone, so what is
late does not depend on how arrivals are cut into micro-batches. A late row does not count in its minute, which may be
closed; it is counted as late in the minute it arrived in. As long as rows arrive in the order of their arrival times,
the watermark never passes a row that is not late, so no row is dropped without being counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.latency import HISTOGRAM_BOUNDS, LABELS

WIDTH, LATENESS = "1 minute", "10 minutes"


def windowed_metrics(
    log: DataFrame,
    ts: str = "ts",
    arrived: str = "arrived_at",
    width: str = WIDTH,
    lateness: str = LATENESS,
    labels: Sequence[str] = LABELS,
    elapsed: str = "elapsed_s",
    bounds: Sequence[float] = HISTOGRAM_BOUNDS,
) -> DataFrame:
    """``window_start, *labels, status, requests, late_rows, runs, sum_s, buckets``: counter and histogram of one pass.

    ``requests`` leaves out rejections before a model was chosen, ``runs`` and the cumulative ``buckets`` cover runs that
    reached a model. On a stream in append mode a window comes out once, when the watermark has passed its end; on a
    table all windows come out. Rows without an event time are late, rows without either time are left out. State is one row per open
    window and label combination.
    """
    x, stage = F.col(elapsed), F.coalesce(F.col("error_stage"), F.lit(""))
    at, came = F.col(ts).cast("timestamp"), F.col(arrived).cast("timestamp")
    late = F.coalesce(at < came - F.expr(f"INTERVAL {lateness}"), at.isNull())
    rows = log.withColumn("_late", late).withColumn("_at", F.when(F.col("_late"), came).otherwise(at))
    counted = ~F.col("_late") & ~stage.isin("validation", "routing")
    ran = ~F.col("_late") & (F.col("error_stage").isNull() | (stage == "run"))
    grouped = rows.withWatermark("_at", lateness).groupBy(F.window("_at", width).alias("_window"), *labels, "status")
    found = grouped.agg(
        F.count_if(counted).alias("requests"),
        F.count_if(F.col("_late")).alias("late_rows"),
        F.count_if(ran).alias("runs"),
        F.coalesce(F.sum(F.when(ran, x)), F.lit(0.0)).alias("sum_s"),
        *[F.count_if(ran & (x <= F.lit(float(b)))).alias(f"_b{i}") for i, b in enumerate(bounds)],
    )
    buckets = F.array(*[F.col(f"_b{i}") for i in range(len(bounds))], F.col("runs"))
    return found.select(
        F.col("_window.start").alias("window_start"), *labels, "status", "requests", "late_rows", "runs", "sum_s", buckets.alias("buckets")
    )
