import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.operators import latency as lat
from quillmesh.operators import reports


def log(spark, rows):
    return spark.createDataFrame(
        [(t, m, m.title(), i, ms, err) for t, m, i, ms, err in rows],
        "task string, model_name string, model_class string, iteration int, latency_ms double, error string",
    )


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([0.5, 1.0, 1.0, 2.25, 7.5, 100.0]) | st.floats(0, 1e6), min_size=1, max_size=60))
def test_exact_quantiles_property(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double")
    out = {r.k: r for r in lat.exact_quantiles(df, ["k"], "v", (0.0, 0.5, 0.95, 0.99, 1.0)).collect()}
    expected = np.percentile(values, [0, 50, 95, 99, 100])
    assert [out["a"][f"q{i}"] for i in range(5)] == pytest.approx(expected.tolist())


def test_exact_quantiles_on_many_rows(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.lognormal(3, 1, 60_000), 3)
    df = spark.createDataFrame([("hot", float(v)) for v in values], "k string, v double").repartition(8)
    row = lat.exact_quantiles(df, ["k"], "v").first()
    assert [row.q0, row.q1, row.q2] == pytest.approx(np.percentile(values, [50, 95, 99]).tolist(), rel=1e-12)


def test_values_in_brackets_are_ordered_in_small_ranges(spark, monkeypatch):
    """With wide brackets nearly every value is kept; none of the ordered ranges holds many of them."""
    monkeypatch.setattr(lat, "ACCURACY", 10)
    monkeypatch.setattr(lat, "BLOCKS", 50)
    values = [float(v) for v in np.random.default_rng(6).permutation(5000)]
    df = spark.createDataFrame([(None, v) for v in values] + [("b", 2.0)] * 3, "k string, v double").repartition(4)
    row = {r.k: r for r in lat.exact_quantiles(df, ["k"], "v", (0.1, 0.5, 0.99)).collect()}
    assert [row[None][f"q{i}"] for i in range(3)] == pytest.approx(np.percentile(values, [10, 50, 99]).tolist())
    assert [row["b"][f"q{i}"] for i in range(3)] == [2.0] * 3
    cells = df.select("k", F.lit(1).alias("_n"), F.col("v").alias("_lo"), F.col("v").alias("_hi"))
    ranked = lat._ranked(cells, ["k"])
    assert max(r["count"] for r in ranked.groupBy("k", "_block").count().collect()) < 300


def test_latency_stats(spark):
    runs = [3.0, 1.0, 8.0, 4.0]
    rows = [("embed", "a", i, v, None) for i, v in enumerate(runs)] + [("embed", "one", 0, 5.0, None)]
    rows += [("embed", "bad", 0, 1.0, None), ("embed", "bad", 1, None, "boom"), ("rerank", "none", 0, None, None)]
    out = {r.model_name: r for r in lat.latency_stats(log(spark, rows)).collect()}
    a = out["a"]
    assert a.mean_ms == statistics.mean(runs) and a.median_ms == statistics.median(runs)
    assert a.std_ms == pytest.approx(statistics.stdev(runs))
    assert [a.p95_ms, a.p99_ms] == pytest.approx(np.percentile(runs, [95, 99]).tolist())
    assert a.qps == pytest.approx(1000 / statistics.mean(runs))
    assert (out["one"].std_ms, out["one"].p99_ms, out["one"].status) == (0.0, 5.0, "ok")
    assert (out["bad"].status, out["bad"].error, out["bad"].mean_ms) == ("failed", "boom", None)
    assert (out["none"].status, out["none"].error) == ("failed", "No latency data")
    assert {r.model_name for r in lat.failed_models(lat.latency_stats(log(spark, rows))).collect()} == {"bad", "none"}
    approx = {r.model_name: r for r in lat.latency_stats(log(spark, rows), approximate=True).collect()}
    assert approx["a"].mean_ms == a.mean_ms and approx["a"].p99_ms in runs


def test_ranking_skips_tasks_with_one_model(spark):
    rows = [("embed", m, i, v + i, None) for m, v in (("slow", 9.0), ("fast", 1.0), ("mid", 4.0)) for i in range(3)]
    rows += [("rerank", "only", 0, 1.0, None), ("rerank", "bad", 0, None, "x")]
    ranking = lat.rank_models(lat.latency_stats(log(spark, rows)))
    assert [(r.position, r.model_name) for r in ranking.orderBy("position").collect()] == [(1, "fast"), (2, "mid"), (3, "slow")]
    lines = [r.line for r in reports.comparison_report(ranking).orderBy("line_no").collect()]
    assert lines[0].startswith("Embedding Models") and lines[1] == "  1. fast: 2.00 ms (QPS: 500.00)"


def test_drop_warmup(spark):
    rows = [("embed", m, i, float(i), None) for m in "ab" for i in range(9)] + [("embed", "few", i, 0.0, None) for i in range(3)]
    df = log(spark, rows).repartition(3)
    kept = lat.drop_warmup(df, ["task", "model_name"], ["iteration"], 5)
    assert sorted((r.model_name, r.iteration) for r in kept.collect()) == [(m, i) for m in "ab" for i in range(5, 9)]
    plan = kept._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def requests(spark):
    rows = [
        ("embed", "m", "C", 200, None, 0.004), ("embed", "m", "C", 200, None, 0.3), ("embed", "m", "C", 200, None, 16.0),
        ("embed", "m", "C", 500, "run", 20.0), ("embed", "m", "C", 400, "capability", 0.0),
        ("embed", "m", "C", 400, "validation", 0.0), ("embed", "m", "C", 400, "routing", 0.0),
    ]
    schema = "model_type string, model_name string, model_cls string, status int, error_stage string, elapsed_s double"
    return spark.createDataFrame(rows, schema)


def test_request_counter(spark):
    out = {r.status: r.requests for r in lat.request_counter(requests(spark)).collect()}
    assert out == {200: 3, 500: 1, 400: 1}


def test_histogram_and_timeouts(spark):
    rows = lat.latency_histogram(requests(spark)).collect()
    out = {r.le: r.bucket_count for r in rows}
    assert len(out) == 15
    assert (out["0.005"], out["0.25"], out["0.5"], out["10.0"], out["+Inf"]) == (1, 1, 2, 2, 4)
    assert {(round(r.sum_s, 3), r["count"]) for r in rows} == {(36.304, 4)}
    assert tuple(lat.timeouts(requests(spark)).select("timeouts", "runs").first()) == (2, 4)


def test_report_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(reports.fixed(F.col("x"), 2)).collect()] == ["nan", "inf", "-inf", "2.00"]
    rows = [("embed", "a", 0, 2.0, None), ("embed", "b", 0, None, "boom")]
    lines = {r.model_name: [] for r in reports.latency_report(lat.latency_stats(log(spark, rows))).collect()}
    for r in reports.latency_report(lat.latency_stats(log(spark, rows))).orderBy("line_no").collect():
        lines[r.model_name].append(r.line)
    assert lines["a"][:2] == ["✅ a:", "   Mean latency: 2.00 ms"] and len(lines["a"]) == 7
    assert lines["b"] == ["❌ b: boom"]


def test_null_keys_are_keys(spark):
    rows = [("t", None, i, float(i)) for i in range(10)] + [("t", "m", i, float(i)) for i in range(4)]
    log = spark.createDataFrame(rows, "task string, model string, iteration int, latency_ms double")
    out = {r.model: r.q0 for r in lat.exact_quantiles(log, ["task", "model"], "latency_ms", (0.5,)).collect()}
    assert out == {None: 4.5, "m": 1.5}
    kept = lat.drop_warmup(log, ["task", "model"], ["iteration"], 3).collect()
    assert sorted(str(r.model) for r in kept) == ["None"] * 7 + ["m"]
