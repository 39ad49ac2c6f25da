"""Catalogue queries over Spark mechanisms of their own: event-time windows, keyed state, buckets, placement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillmesh.functions.text import tokens
from quillmesh.operators import evaluation as ev
from quillmesh.operators import requests as req
from quillmesh.operators.inference import embed, gather_models, token_batches
from quillmesh.operators.runners import RunnerSpec, default_registry
from quillmesh.plans import fixtures as fx
from quillmesh.plans.catalog import _docs, _events, _partial_golden, _scores, big, query, r6
from quillmesh.session import scratch_path
from quillmesh.sources.sinks import write_bucketed
from quillmesh.sources.tables import read_request_lines, stream_table, table
from quillmesh.streaming import jobs, pieces, windows

BUCKETS = 8


@query
def minute_metrics(spark, sf):
    """Counter and histogram per minute from one stream in append mode; closed minutes only."""
    out = scratch_path(spark, "minute-metrics")
    log = fx.arrivals(stream_table(spark, sf, "events", _events(spark, sf).schema))
    jobs.start_append(windows.windowed_metrics(log), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{out}/data")
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("minute"), "model_type", "model_name", "model_cls", big("status").alias("status"),
        "requests", "late_rows", "runs", F.round("sum_s", 4).alias("sum_s"), F.array_join(F.col("buckets").cast("array<string>"), ",").alias("buckets"),
    )


@query
def late_rows(spark, sf):
    """How many rows of the log came too late for their minute, by label, from the same metrics over the whole table."""
    rows = windows.windowed_metrics(fx.arrivals(_events(spark, sf)))
    return rows.groupBy("model_type", "model_name").agg(F.sum("late_rows").alias("late_rows"), F.sum("runs").alias("runs"))


@query
def regroup_pieces(spark, sf):
    """Answers that arrive one by one in shuffled order over several micro-batches, put together by keyed state."""
    out = scratch_path(spark, "regroup")
    rows = req.explode_texts(fx.text_requests(table(spark, sf, "conversations")).withColumn("n_texts", F.size("texts")))
    arrived = F.timestamp_add("SECOND", F.col("pos"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    answers = rows.select("request_id", "pos", "n_texts", F.md5("text").alias("answer"), F.lit(None).cast("string").alias("error"), arrived.alias("arrived_at"))
    answers.repartition(6, F.xxhash64("answer")).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    pieces.start_regroup(pieces.regroup_stream(stream, "1 hour"), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    back = spark.read.parquet(f"{out}/data")
    return back.select("request_id", big(F.size("results")).alias("n_results"), F.array_join("results", ",").alias("answers"))


@query
def bucketed_alignment(spark, sf):
    """Generated and golden scores stored in buckets of their keys and aligned without a shuffle."""
    path, name = scratch_path(spark, "bucketed"), f"quillmesh_{uuid.uuid4().hex}"
    keys = ["sample_id", "pos"]
    scores = _scores(spark, sf)
    generated = write_bucketed(scores, f"{name}_g", f"{path}/generated", keys, BUCKETS)
    golden = write_bucketed(_partial_golden(spark, sf, scores).select(*keys, "score"), f"{name}_r", f"{path}/golden", keys, BUCKETS)
    rows = ev.align(generated, golden, keys)
    return rows.select("sample_id", big("pos").alias("pos"), F.col("gen_doc_id").alias("doc_id"), "gen_score", "ref_score")


@query
def request_lines(spark, sf):
    """JSON lines of which some are cut off or of other types; these are kept as 400 rows."""
    path = scratch_path(spark, "request-lines")
    fx.request_lines(fx.embed_requests(_docs(spark, sf))).write.text(path)
    rows = req.reject_corrupt_lines(req.validate_embed(read_request_lines(spark, path)))
    return rows.select(
        F.coalesce(F.col("request_id").cast("string"), F.md5("corrupt_line")).alias("request"), "model", big(F.size("texts")).alias("n_texts"),
        big("status").alias("status"), F.regexp_replace("error", ", in part-.*$", "").alias("error"), "error_stage",
    )


@query
def token_budget_batches(spark, sf):
    """Documents in batches of bounded padded size, embedded batch by batch; the vectors are those of any other order."""
    rows = token_batches(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    done = embed(rows, RunnerSpec("embed", "HashedDenseRunner", batch_size=64), want_sparse=False)
    weighted = F.zip_with("dense_embed", F.sequence(F.lit(1), F.size("dense_embed")), lambda x, i: x.cast("double") * i)
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return done.select("doc_id", "batch_no", "padded_tokens", (F.round(total, 3) + F.lit(0.0)).alias("dense_total"))


@query
def placed_models(spark, sf):
    """Most rows ask for one model; rows are placed by measured counts before inference."""
    kind = F.pmod("doc_id", F.lit(20))
    name = F.when(kind == 18, "dense_only").when(kind == 19, "sparse_only").otherwise("default")
    rows = gather_models(_docs(spark, sf).select("doc_id", "text", name.alias("model")), "doc_id", 16)
    done = embed(rows, default_registry())
    first = F.array_max(F.transform("dense_embed", lambda x: F.abs(x.cast("double"))))
    return done.select("doc_id", "model", big(F.size("dense_embed")).alias("dims"), r6(first).alias("largest"), big(F.size("sparse_embed")).alias("n_tokens"))


@query
def token_counts(spark, sf):
    """Texts by padded length: how much of a batch is padding."""
    size = F.size(tokens(F.col("text")))
    rows = _docs(spark, sf).select(F.greatest(F.ceil(size / 64) * 64, F.lit(64)).cast("bigint").alias("padded_tokens"), size.alias("size"))
    return rows.groupBy("padded_tokens").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("tokens"))
