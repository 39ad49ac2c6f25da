import json

from quillmesh.operators.runners import default_registry
from quillmesh.plans import fixtures as fx
from quillmesh.plans.serving import serve_embed, serve_rerank
from quillmesh.sources.sinks import write_benchmark, write_evaluation
from quillmesh.sources.tables import read_requests, stream_requests, table
from quillmesh.operators.latency import latency_histogram, latency_stats, request_counter
from quillmesh.operators.evaluation import summarize
from quillmesh.operators.reports import evaluation_report
from quillmesh.streaming import jobs


def body_files(spark, data, path):
    docs = table(spark, data, "documents")
    fx.embed_requests(docs).repartition(4).write.json(str(path))
    return str(path)


def plain(rows, *names):
    return sorted(str([r[n] for n in names]) for r in rows)


def test_embed_stream_equals_batch(spark, data, tmp_path):
    path = body_files(spark, data, tmp_path / "in")
    registry = default_registry()
    stream = jobs.embed_stream(stream_requests(spark, path, max_files=1), registry)
    jobs.start_append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = serve_embed(read_requests(spark, path, "json"), registry, layout="requests").collect()
    names = ("request_id", "status", "error", "dense_embed", "sparse_embed")
    assert plain(got, *names) == plain(want, *names) and len(got) == 200


def test_restart_answers_only_new_requests(spark, tmp_path):
    registry = default_registry()

    def arrive(name, rid, query):
        (tmp_path / "in").mkdir(exist_ok=True)
        line = {"request_id": rid, "body": json.dumps({"query": query, "texts": [query, "zzz"]})}
        (tmp_path / "in" / name).write_text(json.dumps(line) + "\n")

    def run():
        stream = jobs.rerank_stream(stream_requests(spark, str(tmp_path / "in")), registry)
        jobs.start_append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    arrive("a.json", 1, "red fox")
    assert len(run()) == 2
    arrive("b.json", 2, "blue fox")
    got = run()
    want = serve_rerank(read_requests(spark, str(tmp_path / "in"), "json"), registry).collect()
    assert plain(got, "request_id", "pos", "score") == plain(want, "request_id", "pos", "score") and len(got) == 4


def test_metrics_stream_equals_batch(spark, data, tmp_path):
    log = fx.request_log(table(spark, data, "events"))
    log.repartition(5).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    jobs.start_snapshot(jobs.metrics_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = jobs.read_snapshot(spark, str(tmp_path / "out")).collect()
    names = ("model_type", "model_name", "model_cls", "status", "requests")
    assert plain(got, *names) == plain(request_counter(log).collect(), *names)


def test_histogram_stream_equals_batch(spark, data, tmp_path):
    log = fx.request_log(table(spark, data, "events"))
    log.repartition(5).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    jobs.start_snapshot(jobs.histogram_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = jobs.read_snapshot(spark, str(tmp_path / "out")).collect()
    names = ("model_type", "model_name", "model_cls", "le", "bucket_count", "count")
    assert plain(got, *names) == plain(latency_histogram(log).collect(), *names) and got


def test_report_and_benchmark_sinks(spark, tmp_path):
    metrics = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, cosine_similarity double")
    summary = summarize(metrics, ["cosine_similarity"], "dense")
    write_evaluation(evaluation_report(summary), {"dense": metrics}, str(tmp_path / "eval"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "eval" / "report")).collect()]
    assert lines[0] == "=" * 80 and any("ATTENTION" in x for x in lines)
    assert spark.read.json(str(tmp_path / "eval" / "dense")).count() == 2
    log = spark.createDataFrame([("embed", "m", "C", 1.0, None)], "task string, model_name string, model_class string, latency_ms double, error string")
    write_benchmark(latency_stats(log), log, {"warmup_runs": 5}, str(tmp_path / "bench"))
    row = spark.read.json(str(tmp_path / "bench" / "stats")).first()
    assert row.config.warmup_runs == "5" and row.mean_ms == 1.0 and row.timestamp
    assert spark.read.json(str(tmp_path / "bench" / "latencies")).count() == 1
