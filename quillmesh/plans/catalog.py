"""The query catalogue: every operator run over the whole driver tables, flat scalar columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import clean_html, encode, join_history, pack_pair, strip, token_ids
from quillmesh.functions.vectors import score_head, sigmoid, token_weights, trim_colbert
from quillmesh.operators import evaluation as ev
from quillmesh.operators import latency as lat
from quillmesh.operators import lexical as lex
from quillmesh.operators import reports
from quillmesh.operators import requests as req
from quillmesh.operators.inference import dedup_infer, embed, fallback_scores, length_bucket_order, rerank, rewrite
from quillmesh.operators.runners import HEAD_B_OUT, HEAD_W_OUT, RunnerSpec, default_registry
from quillmesh.operators.sampling import zip_pairs
from quillmesh.plans import fixtures as fx
from quillmesh.plans import retrieval
from quillmesh.plans.serving import serve_embed, serve_rerank, serve_rewrite
from quillmesh.session import materialize, scratch_path
from quillmesh.sources.sinks import write_benchmark, write_evaluation, write_results
from quillmesh.sources.tables import read_requests, read_results, retrieval_dataset, spread_out, spread_target, stream_table, table
from quillmesh.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

HEAD = RunnerSpec("rerank", "HeadRerankRunner")
DENSE = RunnerSpec("embed", "HashedDenseRunner", batch_size=4096)
SPARSE = RunnerSpec("embed", "PositionalSparseRunner", batch_size=4096)


def query(fn: Query) -> Query:
    """Register under the function's name, less a trailing underscore."""
    CATALOG[fn.__name__.rstrip("_")] = fn
    return fn


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def joined_md5(ids: Column) -> Column:
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))


def _docs(spark, sf):
    return spread_out(table(spark, sf, "documents"))


def _stream_docs(spark, sf):
    return stream_table(spark, sf, "documents", table(spark, sf, "documents").schema)


def _queries(spark, sf):
    return table(spark, sf, "benchmark")


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings")


def _events(spark, sf):
    return table(spark, sf, "events")


# --- text ---------------------------------------------------------------------------------------


@query
def clean_html_(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", clean_html(F.col("html")).alias("text"), strip(F.col("url")).alias("url"))


@query
def retrieval_dataset_texts(spark, sf):
    queries, corpus = retrieval_dataset(_queries(spark, sf), table(spark, sf, "pages"), corpus_text="html")
    q = queries.select(F.lit("query").alias("split"), F.col("item_id").alias("id"), "text")
    return q.unionByName(corpus.select(F.lit("corpus").alias("split"), F.col("page_id").alias("id"), F.col("html").alias("text")))


@query
def tokenize_pad(spark, sf):
    rows = _docs(spark, sf).select("doc_id", token_ids(F.col("text")).alias("ids"))
    padded, whole = encode(F.col("ids"), 512), encode(F.col("ids"), 8192, padding="longest", truncation=False)
    rows = rows.withColumns({"p": padded, "w": whole})
    return rows.select(
        "doc_id",
        big(F.size("p.input_ids")).alias("padded_length"),
        big(F.aggregate("p.attention_mask", F.lit(0), lambda a, x: a + x)).alias("attended"),
        joined_md5(F.col("p.input_ids")).alias("padded_md5"),
        big(F.size("w.input_ids")).alias("whole_length"),
        joined_md5(F.col("w.input_ids")).alias("whole_md5"),
    )


@query
def pack_pair_(spark, sf):
    pairs = fx.assigned_pairs(_docs(spark, sf), _queries(spark, sf))
    rows = pairs.select("doc_id", "item_id", token_ids(F.col("query")).alias("q"), token_ids(F.col("text")).alias("d"))
    rows = rows.withColumns({"p": pack_pair(F.col("q"), F.col("d"), 512), "w": pack_pair(F.col("q"), F.col("d"), None)})
    return rows.select(
        "doc_id",
        "item_id",
        big(F.aggregate("p.attention_mask", F.lit(0), lambda a, x: a + x)).alias("attended"),
        joined_md5(F.col("p.input_ids")).alias("ids_md5"),
        F.col("p.error").alias("error"),
        joined_md5(F.col("w.input_ids")).alias("whole_md5"),
    )


@query
def zip_first_pairs(spark, sf):
    queries, corpus = retrieval_dataset(_queries(spark, sf), table(spark, sf, "pages"), corpus_text="html")
    pairs = zip_pairs(queries.withColumnRenamed("text", "query"), corpus.select("page_id", "html"), "item_id", "page_id")
    return pairs.select("ordinal", "item_id", "page_id", "query", F.col("html").alias("text"))


@query
def history_join(spark, sf):
    windows = fx.dialogue_windows(spark, sf)
    return windows.select("conv_id", "turn", big(F.size("turns")).alias("n_turns"), join_history(F.col("turns")).alias("history"))


# --- requests -----------------------------------------------------------------------------------


def _chars(texts: Column) -> Column:
    return big(F.aggregate(texts, F.lit(0), lambda a, t: a + F.char_length(t)))


@query
def validate_embed(spark, sf):
    rows = req.validate_embed(fx.embed_requests(_docs(spark, sf)))
    return rows.select(
        "request_id", "model", big(F.size("texts")).alias("n_texts"), _chars(F.col("texts")).alias("n_chars"),
        "scalar_input", "return_dense", "return_sparse", big("status").alias("status"), "error", "error_stage",
    )


@query
def request_files(spark, sf):
    path = scratch_path(spark, "requests")
    fx.embed_requests(_docs(spark, sf)).write.json(path)
    rows = req.validate_embed(read_requests(spark, path, "json"))
    return rows.select(
        "request_id", "model", big(F.size("texts")).alias("n_texts"), _chars(F.col("texts")).alias("n_chars"),
        big("status").alias("status"), "error",
    )


@query
def validate_rerank(spark, sf):
    rows = req.validate_rerank(fx.rerank_requests(_docs(spark, sf), _queries(spark, sf)))
    return rows.select(
        "request_id", "model", F.char_length("query").cast("bigint").alias("query_chars"),
        big(F.size("texts")).alias("n_texts"), _chars(F.col("texts")).alias("n_chars"),
        big("status").alias("status"), "error", "error_stage",
    )


@query
def validate_rewrite(spark, sf):
    rows = req.validate_rewrite(fx.rewrite_requests(fx.dialogue_windows(spark, sf)))
    return rows.select(
        "conv_id", "turn", "model", big(F.size("message")).alias("n_dialogues"),
        _chars(F.flatten("message")).alias("n_chars"), big("status").alias("status"), "error", "error_stage",
    )


@query
def route_and_capability(spark, sf):
    checked = req.validate_embed(fx.embed_requests(_docs(spark, sf)))
    rows = req.check_capability(req.route_model(checked, default_registry().table(spark), "embed"))
    return req.complete_status(rows).select(
        "request_id", "model", "model_cls", big("status").alias("status"), "error", "error_stage"
    )


@query
def explode_regroup(spark, sf):
    requests = fx.text_requests(table(spark, sf, "conversations"))
    rows = req.explode_texts(requests).withColumns(
        {
            "answer": F.md5("text"),
            "status": F.lit(None).cast("int"),
            "error": F.lit(None).cast("string"),
        }
    )
    back = req.regroup_results(rows.drop("text"), ["answer"])
    return back.select(
        "request_id", big(F.size("results")).alias("n_results"),
        F.array_join(F.transform("results", lambda r: r["answer"]), ",").alias("answers"),
    )


@query
def expand_pairs(spark, sf):
    checked = req.validate_rerank(fx.rerank_requests(_docs(spark, sf), _queries(spark, sf)))
    pairs = req.expand_pairs(checked)
    return pairs.select("request_id", big("pos").alias("pos"), F.md5("query").alias("query_md5"), F.md5("text").alias("text_md5"))


# --- weights, vectors, scores --------------------------------------------------------------------


@query
def token_weights_max(spark, sf):
    rows = fx.occurrence_weights(_docs(spark, sf))
    maps = rows.select("doc_id", token_weights(F.col("ids"), F.col("weights")).alias("w"))
    return maps.select("doc_id", F.explode_outer("w").alias("token_id", "weight"))


@query
def lexical_weights(spark, sf):
    docs = _docs(spark, sf)
    total = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    postings = lex.lexical_postings(docs, materialize(lex.fit_lexical(docs), "vocabulary"), total, "doc_id")
    return postings.select("doc_id", "token_id", r6("weight").alias("weight"))


@query
def id_to_token(spark, sf):
    docs = _docs(spark, sf)
    # Tokens of a single document are not in this vocabulary and must be skipped.
    known = materialize(lex.fit_lexical(docs).where(F.col("df") >= 2), "vocabulary")
    postings = lex.long_form(fx.position_weights(docs, "doc_id"), "doc_id", "w")
    named = lex.id_to_token(postings, known, "doc_id")
    return named.select("doc_id", "token", r6("weight").alias("weight"))


@query
def colbert_trim(spark, sf):
    rows = fx.colbert_vectors(_embeddings(spark, sf))
    kept = rows.select("vec_id", trim_colbert(F.col("vecs"), F.col("mask")).alias("v"))
    return kept.select(
        "vec_id", big(F.size("v")).alias("n_vecs"),
        r6(F.aggregate(F.flatten("v"), F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )


@query
def dense_embed(spark, sf):
    rows = embed(_docs(spark, sf).select("doc_id", "text"), DENSE, want_sparse=False)
    return rows.select("doc_id", F.posexplode("dense_embed").alias("dim", "value")).select(
        "doc_id", big("dim").alias("dim"), r6(F.col("value").cast("double")).alias("value")
    )


@query
def sparse_embed(spark, sf):
    rows = embed(_docs(spark, sf).select("doc_id", "text"), SPARSE, want_dense=False)
    return rows.select("doc_id", F.explode_outer("sparse_embed").alias("token_id", "weight")).select(
        "doc_id", "token_id", r6("weight").alias("weight")
    )


@query
def length_bucket_order_(spark, sf):
    ordered = length_bucket_order(_docs(spark, sf).select("doc_id", "text"))
    rows = embed(ordered, RunnerSpec("embed", "HashedEmbedRunner", batch_size=64))
    return rows.select("doc_id", big(F.size("dense_embed")).alias("dims"), big(F.size("sparse_embed")).alias("n_tokens"))


@query
def embed_multi_model(spark, sf):
    names = F.array(F.lit("default"), F.lit("dense_only"), F.lit("sparse_only"))
    docs = _docs(spark, sf).select(
        "doc_id", "text", names[F.pmod("doc_id", F.lit(3)).cast("int")].alias("model")
    )
    rows = dedup_infer(
        docs, lambda d: embed(d, default_registry(), keep=["_key", "_copies"]), "text", "doc_id",
        ["dense_embed", "sparse_embed"], model="model",
    )
    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    return rows.select(
        "doc_id", "model",
        big(F.size("dense_embed")).alias("dims"),
        F.round(total(F.transform("dense_embed", lambda x: F.abs(x.cast("double")))), 4).alias("dense_abs_sum"),
        big(F.size("sparse_embed")).alias("n_tokens"),
        F.round(total(F.map_values("sparse_embed")), 4).alias("sparse_sum"),
    )


@query
def lexical_score_matrix(spark, sf):
    scores = retrieval.match_corpus(_queries(spark, sf), _docs(spark, sf), "item_id", "doc_id")
    return scores.select("item_id", "doc_id", r6("score").alias("score"))


@query
def lexical_score_pair(spark, sf):
    docs, queries = _docs(spark, sf), _queries(spark, sf)
    pairs = fx.assigned_pairs(docs, queries)
    q = fx.position_weights(queries, "item_id").withColumnRenamed("w", "wq")
    d = fx.position_weights(pairs, "doc_id", "item_id").withColumnRenamed("w", "wd")
    rows = lex.lexical_score_pairs(d.join(q, "item_id"), "wq", "wd")
    return rows.select("doc_id", "item_id", r6("score").alias("score"))


@query
def score_head_(spark, sf):
    rows = _embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("cls"))
    w = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(4)]
    rows = rows.withColumn("logit", score_head(F.col("cls"), w, [0.1, -0.2, 0.3, 0.0], HEAD_W_OUT, HEAD_B_OUT))
    return rows.select("vec_id", r6("logit").alias("logit"), r6(sigmoid(F.col("logit"))).alias("score"))


def _reranked(spark, sf, normalize=None):
    pairs = fx.assigned_pairs(_docs(spark, sf), _queries(spark, sf))
    return rerank(pairs, HEAD, normalize=normalize)


@query
def rerank_scores(spark, sf):
    return _reranked(spark, sf).select("doc_id", "item_id", r6("score").alias("score"))


@query
def rerank_sigmoid(spark, sf):
    return _reranked(spark, sf, True).select("doc_id", "item_id", r6("score").alias("score"))


@query
def rerank_fallback(spark, sf):
    pairs = fx.assigned_pairs(_docs(spark, sf), _queries(spark, sf))
    pairs = pairs.select("request_id", "pos", "query", "text")
    rows = fallback_scores(fx.failing_scores(pairs).drop("query", "text"))
    return rows.select(
        "request_id", big("pos").alias("pos"), "score", "fell_back", big("status").alias("status"), "error"
    )


@query
def rewrite_context(spark, sf):
    rows = rewrite(fx.dialogue_windows(spark, sf), RunnerSpec("rewrite", "ContextRewriteRunner"))
    return rows.select("conv_id", "turn", "rewritten")


@query
def retrieve_then_rerank(spark, sf):
    return retrieval.retrieve_then_rerank(_queries(spark, sf), _docs(spark, sf), "item_id", "doc_id", HEAD, digits=6)


# --- serving -------------------------------------------------------------------------------------


@query
def serve_embed_rows(spark, sf):
    rows = serve_embed(fx.embed_requests(_docs(spark, sf)), default_registry())
    return rows.select(
        "request_id", big("pos").alias("pos"), "model", big(F.size("dense_embed")).alias("dims"),
        big(F.size("sparse_embed")).alias("n_tokens"), big("status").alias("status"), "error",
    )


@query
def serve_rerank_rows(spark, sf):
    rows = serve_rerank(fx.rerank_requests(_docs(spark, sf), _queries(spark, sf)), default_registry())
    return rows.select(
        "request_id", big("pos").alias("pos"), "model", r6("score").alias("score"), big("status").alias("status"), "error"
    )


@query
def serve_rewrite_rows(spark, sf):
    rows = serve_rewrite(fx.rewrite_requests(fx.dialogue_windows(spark, sf)), default_registry())
    return rows.select("conv_id", "turn", big("pos").alias("pos"), "rewritten", big("status").alias("status"), "error")


@query
def result_sink(spark, sf):
    path = scratch_path(spark, "results")
    write_results(embed(_docs(spark, sf).select("doc_id", "text"), RunnerSpec("embed", "HashedEmbedRunner", 4096)), path)
    stored = read_results(spark, path)
    return stored.select("doc_id", big(F.size("dense_embed")).alias("dims"), big(F.size("sparse_embed")).alias("n_tokens"))


# --- evaluation ----------------------------------------------------------------------------------


@query
def compare_dense(spark, sf):
    rows = ev.compare_dense(fx.dense_pairs(_embeddings(spark, sf)), "a", "b")
    return rows.select("sample_id", "shape_mismatch", *[r6(m).alias(m) for m in ev.DENSE_METRICS])


_SPARSE_COLUMNS = ("common_keys_count", "generated_keys_count", "reference_keys_count")


@query
def compare_sparse(spark, sf):
    rows = ev.compare_sparse(fx.sparse_pairs(_docs(spark, sf)), "a", "b")
    return rows.select("sample_id", *_SPARSE_COLUMNS, *[r6(m).alias(m) for m in ev.SPARSE_METRICS])


@query
def compare_sparse_long(spark, sf):
    # read once per side; the weights are computed once
    pairs = materialize(fx.sparse_pairs(_docs(spark, sf)), "pairs")
    long = [lex.long_form(pairs, "sample_id", c) for c in ("a", "b")]
    samples = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    rows = ev.compare_sparse_long(long[0], long[1], samples)
    return rows.select("sample_id", *_SPARSE_COLUMNS, *[r6(m).alias(m) for m in ev.SPARSE_METRICS])


@query
def compare_embeddings(spark, sf):
    """Result tables of both kinds: vectors of some samples, sparse weights of others, both of the rest."""
    dense, sparse = fx.dense_pairs(_embeddings(spark, sf)), materialize(fx.sparse_pairs(_docs(spark, sf)), "pairs")
    sides = [
        dense.select("sample_id", F.col(c).alias("dense_embed")).join(
            sparse.select("sample_id", F.col(c).alias("sparse_embed")), "sample_id", "full"
        )
        for c in ("a", "b")
    ]
    found = ev.compare_embeddings(*sides)
    parts = [
        df.select(F.lit(kind).alias("kind"), "sample_id", r6(first).alias("first"), r6(second).alias("second"))
        for kind, df, first, second in (
            ("dense", found[0], "cosine_similarity", "mae"), ("sparse", found[1], "jaccard_similarity", "value_mae")
        )
    ]
    return parts[0].unionByName(parts[1])


def _scores(spark, sf):
    """The scores of all pairs, stored: the golden copies are made from them, and the reranker runs once."""
    scores = _reranked(spark, sf).select(
        F.col("request_id").alias("sample_id"), "pos", "doc_id", r6("score").alias("score")
    )
    return materialize(scores, "scores")


def _partial_golden(spark, sf, scores):
    return fx.golden_scores(scores, table(spark, sf, "labels"))


@query
def compare_scores(spark, sf):
    scores = _scores(spark, sf)
    rows = ev.compare_scores(scores, _partial_golden(spark, sf, scores))
    return rows.select("sample_id", *[r6(m).alias(m) for m in ev.SCORE_METRICS], "score_count")


@query
def alignment_report(spark, sf):
    scores = _scores(spark, sf)
    return ev.alignment_report(scores, _partial_golden(spark, sf, scores), ["sample_id", "pos"])


def _sparse_samples(spark, sf):
    return ev.compare_sparse(fx.sparse_pairs(_docs(spark, sf), lossy=False), "a", "b").drop("a", "b")


def _summary(spark, sf, sparse=None):
    dense = ev.compare_dense(fx.dense_pairs(_embeddings(spark, sf), faults=False), "a", "b")
    sparse = _sparse_samples(spark, sf) if sparse is None else sparse
    produced = _scores(spark, sf)
    scores = ev.compare_scores(produced, fx.golden_scores(produced))
    parts = [
        ev.summarize(dense, ev.DENSE_METRICS, "dense"),
        ev.summarize(sparse, ev.SPARSE_METRICS, "sparse"),
        ev.summarize(scores, ev.SCORE_METRICS, "rerank"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SUMMARY = ("mean", "std", "min", "max")


@query
def eval_summary(spark, sf):
    return _summary(spark, sf).select("kind", "metric", "samples", *[r6(c).alias(c) for c in _SUMMARY])


@query
def eval_summary_raw(spark, sf):
    """Zero vectors and samples without common tokens: NaN and infinity pass through."""
    dense = ev.compare_dense(fx.dense_pairs(_embeddings(spark, sf)), "a", "b")
    sparse = ev.compare_sparse(fx.sparse_pairs(_docs(spark, sf)), "a", "b")
    rows = ev.summarize(dense, ev.DENSE_METRICS, "dense").unionByName(ev.summarize(sparse, ev.SPARSE_METRICS, "sparse"))
    return rows.select("kind", "metric", "samples", *[reports.fixed(F.col(c), 4).alias(c) for c in _SUMMARY])


@query
def verdict(spark, sf):
    return reports.verdict(_summary(spark, sf))


@query
def eval_report(spark, sf):
    rows = reports.evaluation_report(_summary(spark, sf))
    return rows.select(big("line_no").alias("line_no"), "line")


@query
def evaluation_sink(spark, sf):
    """The report and one table of samples, written and read again."""
    path = scratch_path(spark, "evaluation")
    samples = materialize(_sparse_samples(spark, sf), "samples")
    write_evaluation(reports.evaluation_report(_summary(spark, sf, samples)), {"sparse": samples}, path)
    lines = spark.read.text(f"{path}/report").select(F.lit(None).cast("bigint").alias("sample_id"), F.col("value").alias("line"))
    stored = spark.read.json(f"{path}/sparse").select("sample_id", F.col("common_keys_count").cast("string").alias("line"))
    return lines.unionByName(stored)


@query
def benchmark_sink(spark, sf):
    path, log = scratch_path(spark, "benchmark"), fx.latency_log(_events(spark, sf))
    write_benchmark(_stats(spark, sf), log, {"warmup_runs": 5}, path)
    runs = spark.read.json(f"{path}/latencies").groupBy("task", "model_name").agg(F.count("*").alias("runs"), F.max("latency_ms").alias("slowest"))
    stats = spark.read.json(f"{path}/stats").select("task", "model_name", r6("mean_ms").alias("mean_ms"), F.col("config.warmup_runs").alias("warmup_runs"), "status")
    return stats.join(runs, ["task", "model_name"])


@query
def backend_parity(spark, sf):
    rows = ev.backend_parity(fx.tensors(_embeddings(spark, sf)), ["vec_id"])
    return rows.select(
        "vec_id", F.array_join(F.col("shape_b").cast("array<string>"), "x").alias("shape_b"), "shape_match",
        r6("max_abs_err").alias("max_abs_err"), r6("mean_abs_err").alias("mean_abs_err"),
        r6(F.get("preview_b", F.lit(0))).alias("first_b"), big(F.size("preview_a")).alias("n_preview"), "passed",
    )


@query
def backend_parity_overall(spark, sf):
    return ev.all_passed(ev.backend_parity(fx.tensors(_embeddings(spark, sf)), ["vec_id"]))


# --- latency and service metrics -------------------------------------------------------------------


def _stats(spark, sf):
    return lat.latency_stats(fx.latency_log(_events(spark, sf)))


_STATS = ("mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "p95_ms", "p99_ms", "qps")


@query
def latency_stats(spark, sf):
    return _stats(spark, sf).select(
        "task", "model_name", "model_class", "iterations", *[r6(c).alias(c) for c in _STATS], "status", "error"
    )


@query
def failed_models(spark, sf):
    return lat.failed_models(_stats(spark, sf))


@query
def rank_models(spark, sf):
    return lat.rank_models(_stats(spark, sf)).select(
        "task", "position", "model_name", r6("mean_ms").alias("mean_ms"), r6("qps").alias("qps")
    )


@query
def drop_warmup(spark, sf):
    kept = lat.drop_warmup(fx.latency_log(_events(spark, sf)), ["task", "model_name"], ["ts", "event_id"])
    return kept.select("task", "model_name", "event_id", "latency_ms")


@query
def latency_report(spark, sf):
    rows = reports.latency_report(_stats(spark, sf))
    return rows.select("task", "model_name", big("line_no").alias("line_no"), "line")


@query
def comparison_report(spark, sf):
    rows = reports.comparison_report(lat.rank_models(_stats(spark, sf)))
    return rows.select("task", big("line_no").alias("line_no"), "line")


@query
def request_counter(spark, sf):
    rows = lat.request_counter(fx.request_log(_events(spark, sf)))
    return rows.select("model_type", "model_name", "model_cls", big("status").alias("status"), "requests")


@query
def latency_histogram(spark, sf):
    rows = lat.latency_histogram(fx.request_log(_events(spark, sf)))
    return rows.select(
        "model_type", "model_name", "model_cls", "le", "bucket_count", F.round("sum_s", 4).alias("sum_s"), F.col("count").alias("runs")
    )


@query
def timeouts(spark, sf):
    return lat.timeouts(fx.request_log(_events(spark, sf)))


# --- streams -------------------------------------------------------------------------------------


def _run_append(spark, df, name):
    out = scratch_path(spark, name)
    jobs.start_append(df, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query
def embed_stream(spark, sf):
    docs = _stream_docs(spark, sf)
    spread = spread_target(table(spark, sf, "documents"))
    answers = jobs.embed_stream(fx.embed_requests(docs), default_registry(), spread)
    rows = _run_append(spark, answers, "embed-stream")
    return rows.select(
        "request_id", "model", big(F.size("dense_embed")).alias("n_dense"), big(F.size("sparse_embed")).alias("n_sparse"),
        big("status").alias("status"), "error",
    )


@query
def rerank_stream(spark, sf):
    docs = _stream_docs(spark, sf)
    requests = fx.rerank_requests_by_document(docs, _queries(spark, sf))
    rows = _run_append(spark, jobs.rerank_stream(requests, default_registry(), spread_target(table(spark, sf, "documents"))), "rerank-stream")
    return rows.select("request_id", big("pos").alias("pos"), r6("score").alias("score"), big("status").alias("status"), "error")


@query
def rewrite_stream(spark, sf):
    turns = stream_table(spark, sf, "conversations", table(spark, sf, "conversations").schema)
    requests = fx.rewrite_requests(turns.select("conv_id", "turn", F.array("role", "text").alias("turns")))
    rows = _run_append(spark, jobs.rewrite_stream(requests, default_registry()), "rewrite-stream")
    return rows.select("conv_id", "turn", big("pos").alias("pos"), "rewritten", big("status").alias("status"), "error")


@query
def metrics_stream(spark, sf):
    events = stream_table(spark, sf, "events", _events(spark, sf).schema)
    out = scratch_path(spark, "metrics-stream")
    counts = jobs.metrics_stream(fx.request_log(events))
    jobs.start_snapshot(counts, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    rows = jobs.read_snapshot(spark, f"{out}/data")
    return rows.select("model_type", "model_name", "model_cls", big("status").alias("status"), "requests")


# registers its queries in CATALOG
from quillmesh.plans import catalog_mechanisms, catalog_models  # noqa: E402, F401
