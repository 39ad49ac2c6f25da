"""Catalogue queries over user-named runners, whole vocabularies, bounded top-k and complete reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import lexical as lex
from quillmesh.operators import reports, topk
from quillmesh.operators.inference import rerank, rerank_encoded
from quillmesh.operators.runners import RunnerSpec
from quillmesh.plans import fixtures as fx
from quillmesh.plans import retrieval
from quillmesh.plans.catalog import _docs, _events, _queries, _stats, _summary, big, query, r6
from quillmesh.plans.length_runners import HEAD
from quillmesh.session import materialize, scratch_path
from quillmesh.sources.tables import stream_table
from quillmesh.streaming import jobs

MIN_CHARS, MAX_CHARS = 400, 6000


@query
def isolated_failures(spark, sf):
    """A runner that refuses long texts and leaves out short ones: each fails alone, its batch does not."""
    limits = {"min_chars": MIN_CHARS, "max_chars": MAX_CHARS}
    runner = RunnerSpec("rerank", "quillmesh.plans.length_runners:LengthRatioRunner", 16, limits)
    rows = rerank(fx.assigned_pairs(_docs(spark, sf), _queries(spark, sf)), runner)
    return rows.select("doc_id", "item_id", r6("score").alias("score"), big("status").alias("status"), "error")


@query
def head_outside_model(spark, sf):
    """Vectors per pair from a runner, the scoring head and the sigmoid outside of it."""
    runner = RunnerSpec("rerank", "quillmesh.plans.length_runners:LengthEncoderRunner", 256)
    rows = rerank_encoded(fx.assigned_pairs(_docs(spark, sf), _queries(spark, sf)), runner, HEAD, normalize=True)
    return rows.select("doc_id", "item_id", r6("score").alias("score"))


@query
def histogram_stream(spark, sf):
    """Running latency histogram of a stream, as it stands after the last micro-batch."""
    events = stream_table(spark, sf, "events", _events(spark, sf).schema)
    out = scratch_path(spark, "histogram-stream")
    jobs.start_snapshot(jobs.histogram_stream(fx.request_log(events)), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    rows = jobs.read_snapshot(spark, f"{out}/data")
    return rows.select(
        "model_type", "model_name", "model_cls", "le", "bucket_count", F.round("sum_s", 4).alias("sum_s"), F.col("count").alias("runs")
    )


@query
def id_to_token_whole(spark, sf):
    """The corpus' whole vocabulary names its own ids and those of the benchmark; ids it does not know are skipped."""
    docs = _docs(spark, sf)
    known = materialize(lex.fit_lexical(docs), "vocabulary")
    parts = []
    for side, rows, key in (("document", docs, "doc_id"), ("item", _queries(spark, sf), "item_id")):
        postings = lex.long_form(fx.position_weights(rows, key), key, "w")
        named = lex.id_to_token(postings, known, key)
        parts.append(named.select(F.lit(side).alias("side"), big(key).alias("id"), "token", r6("weight").alias("weight")))
    return parts[0].unionByName(parts[1])


@query
def score_matrix_by_token(spark, sf):
    """The matching scores by the path for large query tables: posting lists joined by token, hot ones split."""
    scores = retrieval.match_corpus(_queries(spark, sf), _docs(spark, sf), "item_id", "doc_id", small_chars=-1)
    return scores.select("item_id", "doc_id", r6("score").alias("score"))


@query
def lexical_top_k(spark, sf):
    """Best ten documents of every item, by blocks of postings that upper bounds allow to skip."""
    return topk.lexical_top_k(_queries(spark, sf), _docs(spark, sf), "item_id", "doc_id", 10, digits=6)


@query
def eval_report_counts(spark, sf):
    """The evaluation report with the number of samples under each section's title."""
    rows = reports.evaluation_report(_summary(spark, sf), counts=True)
    return rows.select(big("line_no").alias("line_no"), "line")


@query
def latency_summary(spark, sf):
    """The whole latency report: head, a section per task, the lines of its models in order of their names."""
    rows = reports.latency_summary(materialize(_stats(spark, sf), "stats"), "2024-01-01 00:00:00", 5, 100)
    return rows.select(big("line_no").alias("line_no"), "line")


@query
def verdict_cases(spark, sf):
    """The verdict over one summary as it is, with one or both parts made worse, and with a part left out."""
    summary = materialize(_summary(spark, sf), "summary")
    out = None
    for case, scale, parts in reports_cases():
        worse = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in scale.items() for x in kv]), F.col("kind")), F.lit(1.0)) if scale else F.lit(1.0)
        rows = reports.verdict(summary.where(F.col("kind").isin(parts)).withColumn("mean", F.col("mean") * worse))
        rows = rows.select(F.lit(case).alias("case_name"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def reports_cases() -> list[tuple[str, dict[str, float], list[str]]]:
    """Name, factors of the means by kind, and the kinds that were evaluated."""
    both = ["dense", "rerank"]
    return [
        ("as is", {}, both), ("dense worse", {"dense": 0.5}, both), ("rerank worse", {"rerank": 0.5}, both),
        ("both worse", {"dense": 0.5, "rerank": 0.5}, both), ("only dense", {}, ["dense"]), ("only dense, worse", {"dense": 0.5}, ["dense"]),
        ("only rerank", {}, ["rerank"]), ("only rerank, worse", {"rerank": 0.5}, ["rerank"]), ("nothing", {}, ["sparse"]),
    ]
