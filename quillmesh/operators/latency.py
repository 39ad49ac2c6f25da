"""Latency statistics over logs of timed runs, and service metrics over request logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators.skew import same_key_join

# Percentiles, histogram bounds (seconds), time-out, warm-up runs.
QUANTILES = (0.5, 0.95, 0.99)
HISTOGRAM_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
REST_TIMEOUT = 15.0
WARMUP_RUNS = 5
LABELS = ("model_type", "model_name", "model_cls")
# The bracketing sketch is off by at most 1 / ACCURACY of the rows; brackets are three times as wide.
ACCURACY = 50_000
# Ranges that the values inside the brackets of a key are dealt into before they are put in order.
BLOCKS = 500


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact linearly interpolated quantiles per key, ``(*keys, q0, q1, ...)``, without ever
    gathering a key's values in one task.

    A mergeable sketch brackets each rank; a second pre-aggregated pass counts what lies below,
    between and above the brackets, keeping single values only inside them (a few times
    1/ACCURACY of the rows). That small table is cut into ``BLOCKS`` ranges per key whose counts are summed up
    first, and only within a range values are ordered, so a task sorts some 1e-6 of a key's rows. The wanted
    ranks are then read off.
    """
    keys = list(keys)
    margin = 3.0 / ACCURACY
    probes = sorted({p for q in quantiles for p in (max(q - margin, 0.0), min(q + margin, 1.0))})
    at = {p: i for i, p in enumerate(probes)}
    x = F.col(value)
    rows = df.where(x.isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx(x, [float(p) for p in probes], ACCURACY).alias("_probe")
    )
    bracketed = same_key_join(rows.select(*keys, value), sketch, keys)
    inside = F.lit(False)
    for q in quantiles:
        low, high = at[max(q - margin, 0.0)], at[min(q + margin, 1.0)]
        inside = inside | ((x >= F.col("_probe")[low]) & (x <= F.col("_probe")[high]))
    below = sum((F.when(x > F.col("_probe")[i], 1).otherwise(0) for i in range(len(probes))), F.lit(0))
    cells = bracketed.groupBy(*keys, below.alias("_bin"), F.when(inside, x).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")
    )
    ranked = _ranked(cells, keys)

    def at_rank(rank: Column) -> Column:
        """The value at a 0-based rank: a single value, or either end of an uncut range."""
        here = (F.col("_start") <= rank) & (rank < F.col("_end"))
        known = (
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
            .when(rank == F.col("_start"), F.col("_lo"))
            .when(rank == F.col("_end") - 1, F.col("_hi"))
            .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        )
        return F.max(F.when(here, known))

    picks = []
    for i, q in enumerate(quantiles):
        place = (F.col("_total") - 1) * F.lit(float(q))
        picks += [
            at_rank(F.floor(place)).alias(f"_l{i}"),
            at_rank(F.ceil(place)).alias(f"_h{i}"),
            F.any_value(place - F.floor(place)).alias(f"_f{i}"),
        ]
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
            for i in range(len(quantiles))
        ],
    )


def _ranked(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with ``_start`` and ``_end``, the ranks that a cell covers in its key, and ``_total``, the key's rows."""
    steps = [i / BLOCKS for i in range(1, BLOCKS)]
    cuts = cells.groupBy(*keys).agg(F.percentile_approx("_lo", steps, 10 * BLOCKS).alias("_cuts"))
    block = F.size(F.filter("_cuts", lambda c: c < F.col("_lo"))).alias("_block")
    dealt = same_key_join(cells, cuts, keys).select(*keys, "_n", "_lo", "_hi", block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_block").agg(F.sum("_n").alias("_rows"))
    sums = sums.select(
        *keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_total"),
    )
    within = Window.partitionBy(*keys, "_block").orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    ended = same_key_join(dealt.withColumn("_own", F.sum("_n").over(within)), sums, [*keys, "_block"])
    return ended.withColumn("_end", F.col("_before") + F.col("_own")).withColumn("_start", F.col("_end") - F.col("_n"))


def latency_stats(
    log: DataFrame, keys: Sequence[str] = ("task", "model_name", "model_class"), latency: str = "latency_ms",
    approximate: bool = False,
) -> DataFrame:
    """Mean, median, sample standard deviation, range, p95, p99 and calls per second.

    A model with any error row is ``failed`` and has no statistics. ``approximate`` takes the
    percentiles from the sketch alone, in the single pass of the other statistics.
    """
    keys = list(keys)
    x = F.col(latency)
    probes = (
        [F.percentile_approx(x, [float(q) for q in QUANTILES], ACCURACY).alias("_q")] if approximate else []
    )
    base = log.groupBy(*keys).agg(
        F.count(x).alias("iterations"),
        F.count_if(F.col("error").isNotNull()).alias("_failures"),
        F.avg(x).alias("mean_ms"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std_ms"),
        F.min(x).alias("min_ms"),
        F.max(x).alias("max_ms"),
        *probes,
    )
    # Kept apart: a text in the aggregation buffer would force a sort of the whole log.
    reasons = log.where(F.col("error").isNotNull()).groupBy(*keys).agg(F.min("error").alias("error"))
    if approximate:
        joined = base.withColumns({f"q{i}": F.col("_q")[i] for i in range(len(QUANTILES))})
    else:
        joined = same_key_join(base, exact_quantiles(log, keys, latency), keys, "left")
    joined = same_key_join(joined, reasons, keys, "left")
    ok = (F.col("_failures") == 0) & (F.col("iterations") > 0)
    # A log without a single measurement is an error record of its own.
    reason = F.when(F.col("_failures") > 0, F.col("error")).when(F.col("iterations") == 0, F.lit("No latency data"))
    values = {
        "mean_ms": F.col("mean_ms"),
        "median_ms": F.col("q0"),
        "std_ms": F.col("std_ms"),
        "min_ms": F.col("min_ms"),
        "max_ms": F.col("max_ms"),
        "p95_ms": F.col("q1"),
        "p99_ms": F.col("q2"),
        "qps": F.try_divide(F.lit(1000.0), F.col("mean_ms")),
    }
    return joined.select(
        *keys,
        "iterations",
        *[F.when(ok, v).alias(n) for n, v in values.items()],
        F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        reason.alias("error"),
    )


def drop_warmup(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = WARMUP_RUNS
) -> DataFrame:
    """All but the first ``k`` runs of each model, by ``order`` (a unique ordering).

    Only the k first rows per model are looked up (limited before the shuffle); the log itself is
    filtered in place against the k-th ordering key of its model.
    """
    keys, order = list(keys), list(order)
    ranked = log.select(*keys, *order).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    warm = ranked.where(F.col("_rank") <= k)
    cut = warm.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_cut"))
    return same_key_join(log, cut, keys).where(F.struct(*order) > F.col("_cut")).drop("_cut")


def failed_models(stats: DataFrame) -> DataFrame:
    """Error records, which the comparison leaves out."""
    return stats.where(F.col("status") == "failed").select("task", "model_name", "model_class", "error", "status")


def rank_models(stats: DataFrame) -> DataFrame:
    """Models per task by mean latency, from 1; tasks with a single valid model are not compared."""
    valid = stats.where(F.col("status") == "ok")
    per_task = Window.partitionBy("task")
    return (
        valid.withColumn("position", F.row_number().over(per_task.orderBy("mean_ms", "model_name")).cast("bigint"))
        .withColumn("_models", F.count(F.lit(1)).over(per_task))
        .where(F.col("_models") > 1)
        .select("task", "position", "model_name", "mean_ms", "qps")
    )


def request_counter(log: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Requests by model labels and status; rejections before a model was chosen are not counted."""
    stage = F.coalesce(F.col("error_stage"), F.lit(""))
    counted = log.where(~stage.isin("validation", "routing"))
    return counted.groupBy(*labels, "status").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(
    log: DataFrame, labels: Sequence[str] = LABELS, elapsed: str = "elapsed_s", bounds: Sequence[float] = HISTOGRAM_BOUNDS
) -> DataFrame:
    """Cumulative buckets ``(labels, le, bucket_count, sum_s, count)``; only runs that reached a model.

    One grouped pass with a conditional count per bound; the few result rows are unpivoted.
    """
    x = F.col(elapsed)
    ran = log.where(F.col("error_stage").isNull() | (F.col("error_stage") == "run"))
    counts = [F.count_if(x <= F.lit(float(b))).alias(f"_b{i}") for i, b in enumerate(bounds)]
    grouped = ran.groupBy(*labels).agg(*counts, F.sum(x).alias("sum_s"), F.count(F.lit(1)).alias("count"))
    buckets = [
        F.struct(F.lit(_bound_text(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count")) for i, b in enumerate(bounds)
    ]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("bucket_count")))
    return grouped.select(*labels, F.inline(F.array(*buckets)), "sum_s", "count")


def _bound_text(bound: float) -> str:
    return repr(float(bound))


def timeouts(log: DataFrame, labels: Sequence[str] = LABELS, limit: float = REST_TIMEOUT) -> DataFrame:
    """Runs longer than the limit are counted, never cancelled."""
    ran = log.where(F.col("error_stage").isNull() | (F.col("error_stage") == "run"))
    return ran.groupBy(*labels).agg(
        F.count_if(F.col("elapsed_s") > limit).alias("timeouts"), F.count(F.lit(1)).alias("runs")
    )
