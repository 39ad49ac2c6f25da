"""Request tables in, answer tables out. The same functions run on static and on streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.inference import embed, rerank, rewrite
from quillmesh.operators.requests import (
    check_capability,
    complete_status,
    expand_pairs,
    explode_texts,
    project_outputs,
    route_model,
    validate_embed,
    validate_rerank,
    validate_rewrite,
)
from quillmesh.operators.runners import ModelRegistry


def serve_embed(
    requests: DataFrame, registry: ModelRegistry, layout: str = "rows", strict: bool = True, spread: int | None = None
) -> DataFrame:
    """Embed requests ``(request_id, body, ...)``.

    ``layout='rows'``: one row per text (``pos``), the scalable form. ``layout='requests'``: one row
    per request with arrays of results; no shuffle and no state, hence the form for streams.
    Rejected requests keep one row in both.
    """
    known = registry.table(requests.sparkSession)
    checked = check_capability(route_model(validate_embed(requests, strict=strict), known, "embed"))
    context = [c for c in requests.columns if c != "body"]
    context += ["model", "model_cls", "scalar_input", "return_dense", "return_sparse", "error_stage"]
    if layout == "rows":
        rows = explode_texts(checked, spread=spread)
        answers = project_outputs(embed(rows, registry, "text", keep=[*context, "pos"]))
        tail = ["pos", "dense_embed", "sparse_embed"]
    elif layout == "requests":
        accepted = checked.withColumn("texts", F.when(F.col("status").isNull(), F.col("texts")))
        answers = project_outputs(embed(accepted, registry, "texts", nested=True, keep=context))
        tail = ["dense_embed", "sparse_embed"]
    else:
        raise ValueError(f"unknown layout: {layout}")
    return _closed(answers).select(*context, *tail, "status", "error")


def serve_rerank(
    requests: DataFrame, registry: ModelRegistry, strict: bool = True, spread: int | None = None
) -> DataFrame:
    """Rerank requests -> one row per text with its score, in the order of ``pos``."""
    known = registry.table(requests.sparkSession)
    checked = route_model(validate_rerank(requests, strict=strict), known, "rerank")
    scored = rerank(expand_pairs(checked, spread), registry)
    context = [c for c in requests.columns if c != "body"]
    return _closed(scored).select(*context, "model", "model_cls", "error_stage", "pos", "score", "status", "error")


def serve_rewrite(
    requests: DataFrame, registry: ModelRegistry, strict: bool = True, spread: int | None = None
) -> DataFrame:
    """Rewrite requests -> one row per dialogue with the rewritten query."""
    known = registry.table(requests.sparkSession)
    checked = route_model(validate_rewrite(requests, strict=strict), known, "rewrite")
    done = rewrite(explode_texts(checked, "message", "turns", spread), registry)
    context = [c for c in requests.columns if c != "body"]
    return _closed(done).select(*context, "model", "model_cls", "error_stage", "pos", "rewritten", "status", "error")


def _closed(df: DataFrame) -> DataFrame:
    """Name the stage of a failed run, and mark what succeeded."""
    failed = (F.col("status") == 500) & F.col("error_stage").isNull()
    staged = df.withColumn("error_stage", F.when(failed, F.lit("run")).otherwise(F.col("error_stage")))
    return complete_status(staged)
