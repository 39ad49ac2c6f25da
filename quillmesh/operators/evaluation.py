"""Quality evaluation of produced vectors and scores against golden ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.binding import bind
from quillmesh.functions.vectors import INF, NAN, dense_metrics, sparse_metrics

# Metric names and quality gates.
DENSE_METRICS = ("cosine_similarity", "euclidean_distance", "l2_norm_difference", "mse", "mae")
SPARSE_METRICS = ("jaccard_similarity", "value_mse", "value_mae")
SCORE_METRICS = ("mse", "mae", "correlation")
COSINE_GATE = 0.9
CORRELATION_GATE = 0.8
PARITY_RTOL = 1.0
PARITY_ATOL = 1e-5
PREVIEW = 5


def align(generated: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows present on both sides; other columns get the prefixes ``gen_`` and ``ref_``."""

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])

    return prefixed(generated, "gen_").join(prefixed(reference, "ref_"), list(keys))


def alignment_report(generated: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: sample counts of both sides, the aligned count, and whether they differ."""
    tagged = generated.select(*keys, F.lit(1).alias("_g"), F.lit(0).alias("_r")).unionByName(
        reference.select(*keys, F.lit(0).alias("_g"), F.lit(1).alias("_r"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("_g").alias("_g"), F.max("_r").alias("_r"))
    return sides.agg(
        F.coalesce(F.sum("_g"), F.lit(0)).alias("generated_samples"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("reference_samples"),
        F.coalesce(F.sum(F.col("_g") * F.col("_r")), F.lit(0)).alias("total_samples"),
    ).withColumn("length_mismatch", F.col("generated_samples") != F.col("reference_samples"))


def compare_dense(df: DataFrame, generated: str, reference: str, strict: bool = False) -> DataFrame:
    """Dense metrics per row; rows lacking a vector on either side are left out.

    Vectors of different lengths give NULL metrics and ``shape_mismatch = true``, or an error with
    ``strict``.
    """
    a = F.col(generated).cast("array<double>")
    b = F.col(reference).cast("array<double>")
    mismatch = F.size(generated) != F.size(reference)
    found = F.when(~mismatch, dense_metrics(a, b))
    if strict:
        found = F.when(mismatch, F.raise_error(F.lit("vectors of different length"))).otherwise(found)
    row = bind(
        found, lambda m: F.struct(mismatch.alias("shape_mismatch"), *[m[n].alias(n) for n in DENSE_METRICS])
    )
    return _once_per_row(df, F.col(generated).isNotNull() & F.col(reference).isNotNull(), row)


def _once_per_row(df: DataFrame, condition: Column, row: Column) -> DataFrame:
    """Add the fields of ``row`` and keep the rows that meet ``condition``.

    The generator drops the other rows itself and later filters on the new fields stay above it. A
    plain filter would be pushed below the projection together with a copy of the whole computation.
    """
    return df.select("*", F.inline(F.when(condition, F.array(row))))


def compare_sparse(df: DataFrame, generated: str, reference: str) -> DataFrame:
    """Sparse metrics per row from two maps; rows lacking a map on either side are left out."""
    present = F.col(generated).isNotNull() & F.col(reference).isNotNull()
    return _once_per_row(df, present, sparse_metrics(F.col(generated), F.col(reference)))


def compare_sparse_long(
    generated: DataFrame, reference: DataFrame, samples: DataFrame, key: str = "sample_id"
) -> DataFrame:
    """The same metrics from long-form weights ``(key, token_id, weight)``.

    ``samples`` lists the aligned samples, so that two empty sides still give a row. Both sides are
    brought together by one pre-aggregated grouping on (sample, token) instead of a full outer join.
    """
    tagged = generated.select(key, "token_id", F.col("weight").alias("_g"), F.lit(None).cast("double").alias("_r"))
    tagged = tagged.unionByName(
        reference.select(key, "token_id", F.lit(None).cast("double").alias("_g"), F.col("weight").alias("_r"))
    )
    cells = tagged.groupBy(key, "token_id").agg(F.max("_g").alias("_g"), F.max("_r").alias("_r"))
    diff = F.col("_g") - F.col("_r")
    n_common = F.count(diff)
    sums = cells.groupBy(key).agg(
        F.count(F.lit(1)).alias("_union"),
        n_common.alias("common_keys_count"),
        F.count("_g").alias("generated_keys_count"),
        F.count("_r").alias("reference_keys_count"),
        F.avg(diff * diff).alias("_mse"),
        F.avg(F.abs(diff)).alias("_mae"),
    )
    counts = ("common_keys_count", "generated_keys_count", "reference_keys_count")
    joined = samples.select(key).join(sums, key, "left")
    return joined.select(
        key,
        F.coalesce(F.try_divide(F.col("common_keys_count"), F.col("_union")), F.lit(0.0)).alias("jaccard_similarity"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce("_mse", F.lit(INF)).alias("value_mse"),
        F.coalesce("_mae", F.lit(INF)).alias("value_mae"),
    )


def compare_scores(
    generated: DataFrame, reference: DataFrame, key: str = "sample_id", pos: str = "pos", score: str = "score"
) -> DataFrame:
    """MSE, MAE, Pearson correlation and count per sample over the common positions.

    One score gives correlation 1.0, zero variance gives NaN. Samples without a common position
    have no row. The sums are pre-aggregated, so a huge sample is no burden for one task.
    """
    pairs = align(generated.select(key, pos, score), reference.select(key, pos, score), [key, pos])
    g, r = F.col(f"gen_{score}"), F.col(f"ref_{score}")
    sums = pairs.groupBy(key).agg(
        F.avg((g - r) * (g - r)).alias("mse"),
        F.avg(F.abs(g - r)).alias("mae"),
        F.covar_pop(g, r).alias("_cov"),
        F.stddev_pop(g).alias("_sg"),
        F.stddev_pop(r).alias("_sr"),
        (F.min(g) == F.max(g)).alias("_flat_g"),
        (F.min(r) == F.max(r)).alias("_flat_r"),
        F.count(F.lit(1)).alias("score_count"),
    )
    flat = F.col("_flat_g") | F.col("_flat_r") | (F.col("_sg") * F.col("_sr") == 0)
    ratio = F.try_divide(F.col("_cov"), F.col("_sg") * F.col("_sr"))
    correlation = (
        F.when(F.col("score_count") == 1, F.lit(1.0))
        .when(flat, F.lit(NAN))
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    )
    return sums.select(key, "mse", "mae", correlation.alias("correlation"), "score_count")


def compare_embeddings(generated: DataFrame, reference: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Dense and sparse metrics of two result tables ``(key, dense_embed, sparse_embed)``.

    A sample lacking a field is skipped for that field only.
    """
    pairs = align(generated, reference, [key])
    keep = [key, *DENSE_METRICS, "shape_mismatch"]
    dense = compare_dense(pairs, "gen_dense_embed", "ref_dense_embed").select(*keep)
    sparse = compare_sparse(pairs, "gen_sparse_embed", "ref_sparse_embed").drop(
        *[f"{p}{c}" for p in ("gen_", "ref_") for c in ("dense_embed", "sparse_embed")]
    )
    return dense, sparse


def _propagating_min(c: Column) -> Column:
    """NaN in, NaN out (Spark's own ``min`` ignores NaN unless nothing else is there)."""
    return F.when(F.bool_or(F.isnan(c)), F.lit(NAN)).otherwise(F.min(c))


def summarize(df: DataFrame, metrics: Sequence[str], kind: str) -> DataFrame:
    """``(kind, metric, samples, mean, std, min, max)`` with the population standard deviation.

    All metrics are reduced in one global aggregate; only its single row is turned into lines.
    """
    aggregates = []
    for m in metrics:
        c = F.col(m)
        aggregates.append(
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(m).alias("metric"),
                F.count(c).alias("samples"),
                F.avg(c).alias("mean"),
                F.stddev_pop(c).alias("std"),
                _propagating_min(c).alias("min"),
                F.max(c).alias("max"),
            ).alias(f"_{m}")
        )
    lines = df.agg(*aggregates).select(F.inline(F.array(*[F.col(f"_{m}") for m in metrics])))
    return lines.where(F.col("samples") > 0)


def backend_parity(
    df: DataFrame, keys: Sequence[str], rtol: float = PARITY_RTOL, atol: float = PARITY_ATOL
) -> DataFrame:
    """Per tensor: shapes, errors, previews, and whether |a - b| <= atol + rtol * |b| everywhere.

    Needs ``shape_a, data_a, shape_b, data_b``. A shape mismatch is a failed row without errors.
    """
    a, b = F.col("data_a").cast("array<double>"), F.col("data_b").cast("array<double>")
    match = (F.col("shape_a") == F.col("shape_b")) & (F.size(a) == F.size(b))
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
    return df.select(
        *keys,
        "shape_a",
        "shape_b",
        match.alias("shape_match"),
        F.when(match, F.array_max(gaps)).alias("max_abs_err"),
        F.when(match, F.try_divide(total, F.size(a))).alias("mean_abs_err"),
        F.slice(a, 1, PREVIEW).alias("preview_a"),
        F.slice(b, 1, PREVIEW).alias("preview_b"),
        (match & close).alias("passed"),
    )


def all_passed(parity: DataFrame) -> DataFrame:
    return parity.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))
