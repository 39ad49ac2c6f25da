"""Report lines as rows ``(line_no, line)``, and the overall verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators.evaluation import CORRELATION_GATE, COSINE_GATE

# Report texts and number formats.
RULE = "=" * 80
THIN_RULE = "-" * 50
EVALUATION_TITLE = "EVALUATION REPORT: Generated vs Reference Pickle Files"
EMBEDDING_TITLE = "📊 EMBEDDING COMPARISON RESULTS"
RERANKER_TITLE = "📊 RERANKER COMPARISON RESULTS"
ASSESSMENT_TITLE = "🎯 OVERALL ASSESSMENT"
DENSE_TITLE = "🔹 Dense Embeddings:"
SPARSE_TITLE = "🔹 Sparse Embeddings:"
SCORES_TITLE = "🔹 Reranker Scores:"
DENSE_LINES = [
    ("cosine_similarity", "  Cosine Similarity: %s ± %s", 4),
    ("euclidean_distance", "  Euclidean Distance: %s ± %s", 4),
    ("mse", "  MSE: %s ± %s", 6),
    ("mae", "  MAE: %s ± %s", 6),
]
SPARSE_LINES = [
    ("jaccard_similarity", "  Jaccard Similarity: %s ± %s", 4),
    ("value_mse", "  Value MSE: %s ± %s", 6),
    ("value_mae", "  Value MAE: %s ± %s", 6),
]
SCORE_LINES = [
    ("mse", "  MSE: %s ± %s", 6),
    ("mae", "  MAE: %s ± %s", 6),
    ("correlation", "  Correlation: %s ± %s", 4),
]
GOOD_BOTH = (
    "✅ Results look GOOD - Generated files closely match reference data "
    "(Cosine Similarity: %s, Reranker Correlation: %s)"
)
GOOD_EMBEDDING = (
    "✅ Embedding results look GOOD - Generated embeddings closely match reference data (Cosine Similarity: %s)"
)
GOOD_RERANKER = (
    "✅ Reranker results look GOOD - Generated reranker scores closely match reference data (Correlation: %s)"
)
BAD_EMBEDDING = (
    "❌ Embedding results need ATTENTION - Significant differences detected in embeddings "
    "(Cosine Similarity: %s < 0.9)"
)
BAD_RERANKER = (
    "❌ Reranker results need ATTENTION - Significant differences detected in reranker scores (Correlation: %s < 0.8)"
)
BAD_BOTH = (
    "❌ Results need ATTENTION - Significant differences detected in both components "
    "(Cosine Similarity: %s < 0.9, Correlation: %s < 0.8)"
)
MIXED = (
    "⚠️  Results are MIXED - Some components match well, others need attention "
    "(Cosine Similarity: %s, Correlation: %s)"
)
NOTHING = "Nothing was evaluated"
SAMPLES_LINE = "Total samples compared: "
LATENCY_TITLE = "LATENCY BENCHMARK RESULTS"
LATENCY_HEAD = ("Timestamp: ", "Warmup runs: ", "Benchmark iterations: ")
SECTION_TITLES = {"embed": "📊 EMBEDDING MODELS", "rerank": "📊 RERANKER MODELS"}
MODEL_LINES = [
    ("mean_ms", "   Mean latency: %s ms"),
    ("median_ms", "   Median latency: %s ms"),
    ("p95_ms", "   P95 latency: %s ms"),
    ("p99_ms", "   P99 latency: %s ms"),
    ("qps", "   QPS: %s"),
    ("std_ms", "   Std dev: %s ms"),
]
TASK_TITLES = {"embed": "Embedding Models (sorted by latency):", "rerank": "Reranker Models (sorted by latency):"}


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text; non-finite numbers are spelled nan / inf / -inf."""
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(F.format_string(f"%.{digits}f", value))
    )


def _one_row(summary: DataFrame) -> DataFrame:
    """The dozen summary rows as one row of ``struct<mean, std>`` columns ``kind_metric``."""
    cells = []
    for kind, lines in (("dense", DENSE_LINES), ("sparse", SPARSE_LINES), ("rerank", SCORE_LINES)):
        for metric, _, _ in lines:
            here = (F.col("kind") == kind) & (F.col("metric") == metric)
            cells.append(F.max(F.when(here, F.struct("mean", "std"))).alias(f"{kind}_{metric}"))
        if "samples" in summary.columns:
            cells.append(F.max(F.when(F.col("kind") == kind, F.col("samples"))).alias(f"{kind}_samples"))
    return summary.agg(*cells)


def _verdict(row: DataFrame) -> DataFrame:
    cos_mean, corr_mean = F.col("dense_cosine_similarity.mean"), F.col("rerank_correlation.mean")
    rows = row.withColumns({"embedding_good": cos_mean >= COSINE_GATE, "reranker_good": corr_mean >= CORRELATION_GATE})
    e, r = F.col("embedding_good"), F.col("reranker_good")
    cos, corr = fixed(cos_mean, 4), fixed(corr_mean, 4)
    label = (
        F.when(e.isNull() & r.isNull(), "NOT EVALUATED")
        .when(F.coalesce(e, F.lit(True)) & F.coalesce(r, F.lit(True)), "GOOD")
        .when(F.coalesce(e, F.lit(False)) | F.coalesce(r, F.lit(False)), "MIXED")
        .otherwise("ATTENTION")
    )
    message = (
        F.when(e & r, F.format_string(GOOD_BOTH, cos, corr))
        .when(e.isNull() & r.isNull(), F.lit(NOTHING))
        .when(r.isNull(), F.when(e, F.format_string(GOOD_EMBEDDING, cos)).otherwise(F.format_string(BAD_EMBEDDING, cos)))
        .when(e.isNull(), F.when(r, F.format_string(GOOD_RERANKER, corr)).otherwise(F.format_string(BAD_RERANKER, corr)))
        .when(~e & ~r, F.format_string(BAD_BOTH, cos, corr))
        .otherwise(F.format_string(MIXED, cos, corr))
    )
    return rows.withColumns({"label": label, "message": message})


def verdict(summary: DataFrame) -> DataFrame:
    """One row ``(embedding_good, reranker_good, label, message)`` from a ``summarize`` table.

    A part without any summary counts as not evaluated. NaN never fails a gate.
    """
    return _verdict(_one_row(summary)).select("embedding_good", "reranker_good", "label", "message")


def evaluation_report(summary: DataFrame, counts: bool = False) -> DataFrame:
    """The evaluation report as ``(line_no, line)``; the summary is reduced to one row and read once.

    With ``counts`` both sections state how many samples were compared.
    """
    lines: list[tuple[int, Column]] = []

    def titles(start: int, texts: list[str], shown: Column | None = None) -> None:
        for i, text in enumerate(texts):
            lines.append((start + i, F.lit(text) if shown is None else F.when(shown, F.lit(text))))

    titles(0, [RULE, EVALUATION_TITLE, RULE])
    sections = [
        ("dense", [EMBEDDING_TITLE, THIN_RULE, DENSE_TITLE], DENSE_LINES, 100),
        ("sparse", [SPARSE_TITLE], SPARSE_LINES, 200),
        ("rerank", [RERANKER_TITLE, THIN_RULE, SCORES_TITLE], SCORE_LINES, 300),
    ]
    for kind, heads, formats, start in sections:
        present = F.coalesce(*[F.col(f"{kind}_{m}") for m, _, _ in formats]).isNotNull()
        titles(start, heads, present)
        for i, (metric, form, digits) in enumerate(formats):
            cell = F.col(f"{kind}_{metric}")
            text = F.format_string(form, fixed(cell["mean"], digits), fixed(cell["std"], digits))
            lines.append((start + 10 + i, F.when(cell.isNotNull(), text)))
    if counts:
        compared = F.lit(SAMPLES_LINE)
        lines.append((103, F.concat(compared, F.col("dense_samples").cast("string"))))
        lines.append((303, F.concat(compared, F.col("rerank_samples").cast("string"))))
    titles(400, [ASSESSMENT_TITLE, THIN_RULE])
    lines.append((410, F.col("message")))
    titles(420, [RULE])
    items = F.array(*[F.struct(F.lit(n).alias("line_no"), text.alias("line")) for n, text in lines])
    return _verdict(_one_row(summary)).select(F.inline(items)).where(F.col("line").isNotNull())


def latency_report(stats: DataFrame) -> DataFrame:
    """Summary lines per model: ``(task, model_name, line_no, line)``."""
    ok = F.col("status") == "ok"
    lines = [F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("✅ "), F.col("model_name"), F.lit(":")).alias("line"))]
    for i, (column, form) in enumerate(MODEL_LINES, 1):
        lines.append(
            F.struct(F.lit(i).alias("line_no"), F.format_string(form, fixed(F.col(column), 2)).alias("line"))
        )
    failure = F.concat(F.lit("❌ "), F.col("model_name"), F.lit(": "), F.col("error"))
    failed = F.array(F.struct(F.lit(0).alias("line_no"), failure.alias("line")))
    return stats.select("task", "model_name", F.inline(F.when(ok, F.array(*lines)).otherwise(failed)))


def latency_summary(stats: DataFrame, timestamp: str, warmup_runs: int, iterations: int) -> DataFrame:
    """The whole latency report ``(line_no, line)``: its head, then a titled section per task that has models.

    ``stats`` has one row per model and is read twice. Numbers run over all lines, of which a model has seven at most.
    """
    config = [head + str(value) for head, value in zip(LATENCY_HEAD, (timestamp, warmup_runs, iterations), strict=True)]
    numbered = [F.struct(F.lit(i).alias("line_no"), F.lit(t).alias("line")) for i, t in enumerate([RULE, LATENCY_TITLE, RULE, *config])]
    head = stats.sparkSession.range(1).select(F.lit("").alias("task"), F.lit("").alias("model_name"), F.inline(F.array(*numbered)))
    title = F.create_map(*[F.lit(x) for pair in SECTION_TITLES.items() for x in pair])[F.col("task")]
    section = [F.struct(F.lit(i).alias("line_no"), t.alias("line")) for i, t in enumerate([title, F.lit(THIN_RULE)])]
    sections = stats.select("task").distinct().select("task", F.lit("").alias("model_name"), F.inline(F.array(*section)))
    rows = head.unionByName(sections).unionByName(latency_report(stats))
    place = F.row_number().over(Window.orderBy("task", "model_name", "line_no")) - 1
    return rows.select(place.alias("line_no"), "line")


def comparison_report(ranking: DataFrame) -> DataFrame:
    """Comparison lines per task from ``rank_models``: a title (line 0) and one line per model."""
    line = F.concat(
        F.lit("  "), F.col("position").cast("string"), F.lit(". "), F.col("model_name"), F.lit(": "),
        fixed(F.col("mean_ms"), 2), F.lit(" ms (QPS: "), fixed(F.col("qps"), 2), F.lit(")"),
    )
    titles = F.create_map(*[F.lit(x) for pair in TASK_TITLES.items() for x in pair])
    first = F.row_number().over(Window.partitionBy("task").orderBy("position")) == 1
    with_first = ranking.withColumn("_first", first)
    entry = F.struct(F.col("position").cast("int").alias("line_no"), line.alias("line"))
    title = F.struct(F.lit(0).alias("line_no"), titles[F.col("task")].alias("line"))
    return with_first.select(
        "task", F.inline(F.when(F.col("_first"), F.array(title, entry)).otherwise(F.array(entry)))
    )
