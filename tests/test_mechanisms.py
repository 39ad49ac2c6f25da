"""Windows, keyed state, buckets, placement and batches: what the catalogue's SQL cannot see."""

import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmesh.operators.evaluation import align
from quillmesh.operators.inference import gather_models, token_batches
from quillmesh.operators.ordering import place_within
from quillmesh.operators.requests import reject_corrupt_lines, validate_embed
from quillmesh.plans import fixtures as fx
from quillmesh.sources.sinks import open_bucketed, write_bucketed
from quillmesh.sources.tables import read_request_lines, table
from quillmesh.streaming import jobs, pieces, windows


def test_windowed_metrics_in_many_batches_equal_the_table(spark, data, tmp_path):
    log = fx.arrivals(table(spark, data, "events")).orderBy("arrived_at")
    cuts = [r[0] for r in log.select("arrived_at").collect()][::300]
    for i, (a, z) in enumerate(zip(cuts, [*cuts[1:], None])):
        part = log.where(F.col("arrived_at") >= F.lit(a))
        (part if z is None else part.where(F.col("arrived_at") < F.lit(z))).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = jobs.start_append(windows.windowed_metrics(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) > 2
    got = [str(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    whole = windows.windowed_metrics(log).collect()
    latest = log.agg(F.max(F.when(F.col("ts") < F.col("arrived_at") - F.expr("INTERVAL 10 MINUTES"), F.col("arrived_at")).otherwise(F.col("ts")))).first()[0]
    closed = [r for r in whole if r.window_start + dt.timedelta(minutes=11) <= latest]
    assert sorted(got) == sorted(map(str, closed)) and len(closed) < len(whole)
    late = log.where(F.col("ts") < F.col("arrived_at") - F.expr("INTERVAL 10 MINUTES")).count()
    assert sum(r.late_rows for r in whole) == late > 0


def arrive(spark, path, rows):
    kinds = "request_id string, pos int, n_texts int, answer string, error string, arrived_at timestamp"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(*r[:5], at + dt.timedelta(seconds=r[5])) for r in rows], kinds).coalesce(1).write.mode("append").parquet(path)
    return kinds


def test_pieces_over_batches_come_together_and_leave_no_state(spark, tmp_path):
    path = str(tmp_path / "in")
    arrive(spark, path, [("a", 1, 3, "a1", None, 0), ("b", 0, 1, "b0", None, 1), ("c", 1, 2, "c1", "run exception: bad", 1)])
    arrive(spark, path, [("a", 0, 3, "a0", None, 2), ("a", 0, 3, "again", None, 2), ("d", 0, 2, "d0", None, 2)])
    kinds = arrive(spark, path, [("c", 0, 2, "c0", None, 3), ("a", 2, 3, None, None, 3)])
    arrive(spark, path, [("z", 0, 1, "z0", None, 500)])

    def run():
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(path)
        pieces.start_regroup(pieces.regroup_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {r.request_id: (r.results, r.status, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = run()
    assert got == {
        "a": (["again", "a1", None], 200, None), "b": (["b0"], 200, None), "c": (None, 500, "run exception: bad"),
        "d": (None, 500, "run exception: 1 of 2 answers arrived"), "z": (["z0"], 200, None),
    }
    with pieces.rocksdb_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "answers").load(str(tmp_path / "cp"))
        assert state.count() == 0


def test_bucketed_tables_align_without_a_shuffle(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 97).alias("sample_id"), F.col("id").cast("int").alias("pos"), (F.col("id") / 7).alias("score"))
    keys = ["sample_id", "pos"]
    write_bucketed(rows, "generated_scores", str(tmp_path / "g"), keys, 4)
    write_bucketed(rows.where("pos % 3 = 0"), "golden_scores", str(tmp_path / "r"), keys, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = align(*[open_bucketed(spark, f"again_{n}", str(tmp_path / n), keys, 4) for n in "gr"], keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert found.count() == 167
        plain = align(rows, rows.where("pos % 3 = 0"), keys)
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("generated_scores", "golden_scores", "again_g", "again_r"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_models_are_placed_by_measured_counts(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "big").otherwise(F.concat(F.lit("m"), (F.col("id") / 10 % 5).cast("int"))).alias("model"))
    parts = gather_models(rows, "id", 8).select(F.spark_partition_id().alias("p"), "model").collect()
    sizes, models = Counter(r.p for r in parts), defaultdict(set)
    for r in parts:
        models[r.p].add(r.model)
    assert sum(sizes.values()) == 20_000 and max(sizes.values()) <= 2 * 20_000 / 8
    assert sum(len(m) for m in models.values()) <= 8 + 6
    named = rows.withColumn("model", F.when(F.col("id") > 5, F.col("model")))
    assert gather_models(named, "id", 3).where("model is null").count() == 6
    assert gather_models(rows.where("false"), "id", 3).count() == 0


@pytest.mark.parametrize("budget", [64, 1000])
def test_token_batches_keep_within_the_budget(spark, budget):
    texts = [(i, " ".join(["w"] * n)) for i, n in enumerate([1] * 40 + [70] * 30 + [200, 500, 0, 64, 65])] + [(99, None)]
    rows = token_batches(spark.createDataFrame(texts, "id int, text string"), "id", budget=budget)
    found = rows.withColumn("p", F.spark_partition_id()).collect()
    batches = defaultdict(list)
    for r in found:
        batches[r.batch_no].append(r)
    assert sorted(r.id for r in found) == sorted(i for i, _ in texts) and sorted(batches) == list(range(len(batches)))
    for own in batches.values():
        assert len({(r.padded_tokens, r.p) for r in own}) == 1
        assert len(own) == 1 or sum(r.padded_tokens for r in own) <= budget
        assert all(r.padded_tokens >= len((r.text or "").split()) for r in own)
    assert [batches[n][0].padded_tokens for n in sorted(batches)] == sorted((b[0].padded_tokens for b in batches.values()), reverse=True)


def test_places_within_keys_of_any_size(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else str(i % 7), (i * 37) % 1000) for i in range(1000)]
    got = place_within(spark.createDataFrame(rows, "k string, v int").repartition(9), ["k"], ["v"], "at").collect()
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert sorted((str(r.k), r.at, r.v) for r in got) == sorted((str(k), at, v) for k, vs in want.items() for at, v in enumerate(sorted(vs)))


def test_broken_lines_are_kept(spark, tmp_path):
    lines = ['{"request_id": 1, "body": "{\\"text\\": \\"a\\"}"}', '{"request_id": 2, "bo', '{"request_id": "x", "body": "{}"}', "[]", "", '{"body": "{}"}', '{"request_id": 3}']
    (tmp_path / "part-0.json").write_text("\n".join(lines))
    rows = reject_corrupt_lines(validate_embed(read_request_lines(spark, str(tmp_path)))).collect()
    broken = [r for r in rows if r.corrupt_line is not None]
    assert {r.corrupt_line for r in broken} == {lines[1], lines[2]} | ({"[]"} if len(broken) == 3 else set())
    assert {r.error for r in broken} == {"valid error: the line is not a JSON request, in part-0.json"}
    assert all(r.status == 400 and r.source_file == "part-0.json" and r.request_id is None for r in broken)
    assert sorted((r.request_id, r.status) for r in rows if r.request_id is not None) == [(1, None), (3, 400)]
