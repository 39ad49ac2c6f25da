import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import inference as inf
from quillmesh.operators.runners import RunnerSpec, default_registry
from tiny_onnx import tiny_model, tiny_tokenizer

TEXTS = ["the cat sat", "", "a a a b", "cat", "!!", "the dog and the cat", "zebra " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")


def result(df):
    return {r.id: (r.dense_embed, r.sparse_embed) for r in df.collect()}


@pytest.mark.parametrize(("batch", "parts"), [(1, 1), (3, 2), (100, 7)])
def test_embedding_is_independent_of_batching(docs, batch, parts):
    base = result(inf.embed(docs, RunnerSpec("embed", "HashedEmbedRunner", 12)))
    assert result(inf.embed(docs.repartition(parts), RunnerSpec("embed", "HashedEmbedRunner", batch))) == base


def test_hashed_embedding_values(docs):
    import hashlib

    out = result(inf.embed(docs, RunnerSpec("embed", "HashedEmbedRunner", 12)))
    dense, sparse = out[2]
    ids = [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in ("a", "a", "a", "b")]
    v = np.zeros(64)
    for i in ids:
        v[i % 64] += 1 - 2 * ((i // 64) % 2)
    assert dense == pytest.approx((v / np.linalg.norm(v)).tolist(), abs=1e-6)
    assert sparse == {ids[0]: 1.0, ids[3]: pytest.approx(1 / (1 + 3 / 512))}
    assert out[1] == ([0.0] * 64, {})


def test_wants_prune_outputs(docs):
    dense_only = inf.embed(docs, RunnerSpec("embed", "HashedEmbedRunner"), want_sparse=False)
    assert all(s is None and d for d, s in result(dense_only).values())
    sparse_only = inf.embed(docs, RunnerSpec("embed", "HashedEmbedRunner"), want_dense=False)
    assert all(d is None and s is not None for d, s in result(sparse_only).values())


def test_one_bad_text_fails_alone(spark):
    pairs = spark.createDataFrame([(i, "q", "BAD" if i == 5 else "x" * i) for i in range(12)], "id int, query string, text string")
    out = {r.id: r for r in inf.rerank(pairs.coalesce(1), RunnerSpec("rerank", "fault_runners:Raises", 4)).collect()}
    assert out[5].status == 500 and out[5].error == "run exception: bad text" and out[5].score is None
    assert all(out[i].score == float(i) and out[i].status is None for i in range(12) if i != 5)


def test_wrong_length_is_never_misaligned(spark):
    pairs = spark.createDataFrame([(i, "q", "SHORT" if i == 2 else "x" * i) for i in range(8)], "id int, query string, text string")
    out = {r.id: r for r in inf.rerank(pairs.coalesce(1), RunnerSpec("rerank", "fault_runners:WrongLength", 4)).collect()}
    assert out[2].status == 500 and "0 results for 1 inputs" in out[2].error
    assert all(out[i].score == float(i) for i in range(8) if i != 2)


def test_rejected_rows_do_not_reach_the_model(spark):
    pairs = spark.createDataFrame(
        [(0, "q", "BAD", 400, "no"), (1, "q", "xx", None, None)], "id int, query string, text string, status int, error string"
    )
    out = {r.id: r for r in inf.rerank(pairs, RunnerSpec("rerank", "fault_runners:Raises")).collect()}
    assert (out[0].status, out[0].error, out[0].score) == (400, "no", None)
    assert out[1].score == 2.0


def test_fallback_replaces_the_whole_request(spark):
    rows = [(r, p, "q", "BAD" if (r, p) == (1, 2) else "x" * (p + 1)) for r in range(3) for p in range(7)]
    pairs = spark.createDataFrame(rows, "request_id bigint, pos int, query string, text string")
    scored = inf.rerank(pairs, RunnerSpec("rerank", "fault_runners:Raises", 5))
    for r in inf.fallback_scores(scored).collect():
        assert r.score == (1.0 if r.request_id == 1 else float(r.pos + 1))
        assert r.fell_back == (r.request_id == 1)


def test_mixed_models_in_one_pass(spark, docs):
    models = {
        "ids": RunnerSpec("embed", "HashedEmbedRunner"),
        "sparse": RunnerSpec("embed", "PositionalSparseRunner"),
        "own": RunnerSpec("embed", "fault_runners:TextEmbed"),
    }
    named = docs.withColumn("model", F.element_at(F.array(*[F.lit(m) for m in models]), (F.col("id") % 3 + 1).cast("int")))
    out = {r.id: r for r in inf.embed(named, models).collect()}
    assert "text" not in out[0].asDict()
    single = result(inf.embed(docs, models["ids"]))
    for i, text in enumerate(TEXTS):
        if i % 3 == 0:
            assert (out[i].dense_embed, out[i].sparse_embed) == single[i]
        elif i % 3 == 1:
            assert out[i].dense_embed is None and out[i].sparse_embed == single[i][1]
        else:
            assert out[i].dense_embed == [float(len(text)), 1.0] and out[i].sparse_embed == {len(text) + 10: 0.5}


def test_nested_failure_fails_the_request_only(spark):
    df = spark.createDataFrame([(0, ["a", "boom"]), (1, ["b", "cc"]), (2, None), (3, [])], "id int, texts array<string>")
    out = {r.id: r for r in inf.embed(df.coalesce(1), RunnerSpec("embed", "fault_runners:TextEmbed"), "texts", nested=True).collect()}
    assert out[0].status == 500 and out[0].dense_embed is None
    assert out[1].dense_embed == [[1.0, 1.0], [2.0, 1.0]] and out[1].sparse_embed == [{11: 0.5}, {12: 0.5}]
    assert out[2].dense_embed is None and out[3].dense_embed == []


def test_dedup_runs_once_per_text_and_keeps_every_row(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    seen = []

    def infer(distinct):
        seen.append(distinct.count())
        return inf.embed(distinct, RunnerSpec("embed", "HashedEmbedRunner"), keep=["_key", "_copies"])

    out = inf.dedup_infer(df, infer, "text", "id", ["dense_embed", "sparse_embed"])
    assert result(out) == result(inf.embed(df, RunnerSpec("embed", "HashedEmbedRunner")))
    assert seen == [21]
    assert "text" not in out.columns
    kept = inf.dedup_infer(df, infer, "text", "id", ["dense_embed"], keep_text=True)
    assert {(r.id, r.text) for r in kept.collect()} == set(rows)


def test_python_rewrite_runner_and_registry_types(spark):
    df = spark.createDataFrame([(["a", "b c"],)], "turns array<string>")
    assert inf.rewrite(df, RunnerSpec("rewrite", "fault_runners:Upper")).first().rewritten == "B C"
    with pytest.raises(ValueError):
        inf.rewrite(df, RunnerSpec("embed", "HashedEmbedRunner"))
    assert set(default_registry().specs("embed")) == {"default", "dense_only", "sparse_only"}


def test_normalize_is_always_honoured(spark):
    df = spark.createDataFrame([("a b", "a b c")], "query string, text string")
    raw = inf.rerank(df, RunnerSpec("rerank", "HeadRerankRunner")).first().score
    mapped = inf.rerank(df, RunnerSpec("rerank", "HeadRerankRunner", kwargs={"normalize": True})).first().score
    assert mapped == pytest.approx(1 / (1 + np.exp(-raw)))
    python = RunnerSpec("rerank", "fault_runners:Raises")
    assert inf.rerank(df, python, normalize=True).first().score == pytest.approx(1 / (1 + np.exp(-5.0)))


def test_rewrite_keeps_every_word(spark):
    turns = [" ".join(f"early{i}" for i in range(60)), " ".join(f"late{i}" for i in range(30))]
    df = spark.createDataFrame([(turns,), (["only one turn"],)], "turns array<string>")
    out = [r.rewritten for r in inf.rewrite(df, RunnerSpec("rewrite", "ContextRewriteRunner")).collect()]
    assert out[0].split() == [f"late{i}" for i in range(30)] + [f"early{i}" for i in range(60)]
    assert out[1] == "only one turn"


def test_null_and_empty_texts_are_different_keys(spark):
    rows = [(1, None, "m"), (2, "", "m"), (3, "a", None), (4, "a", "m"), (5, "x\u0001m", None), (6, "x", "m"), (7, "", "m")]
    df = spark.createDataFrame(rows, "id int, text string, model string")
    for model in (None, "model"):
        seen = lambda d: d.withColumn("n", F.coalesce(F.length("text"), F.lit(-1)))
        out = inf.dedup_infer(df, seen, "text", "id", ["n"], model=model).select("id", "n").collect()
        assert sorted(map(tuple, out)) == [(i, -1 if t is None else len(t)) for i, t, _ in rows]


def test_fallback_keeps_requests_without_id(spark):
    df = spark.createDataFrame([(None, 0, 0.5, 200), (None, 1, 0.6, 500), (1, 0, 0.7, 200)], "request_id bigint, pos int, score double, status int")
    out = sorted(((r.request_id or 0), r.pos, r.score) for r in inf.fallback_scores(df).collect())
    assert out == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 0.7)]


def test_onnx_embed(spark, tmp_path):
    kwargs = {"model_path": tiny_model(tmp_path / "m.onnx"), "tokenizer_path": tiny_tokenizer(tmp_path / "t.json")}
    df = spark.createDataFrame([(0, "red red blue"), (1, ""), (2, "green what")], "id bigint, text string")
    for batch in (1, 2, 12):
        out = result(inf.embed(df, RunnerSpec("embed", "OnnxEmbedRunner", batch, kwargs)))
        # ids: 0 4 4 6 2 | 0 2 | 0 5 3 2
        assert out[0] == ([16.0, 5.0], {4: 4.0, 6: 6.0})
        assert out[1] == ([2.0, 2.0], {})
        assert out[2] == ([10.0, 4.0], {5: 5.0})
    dense = {**kwargs, "model_path": tiny_model(tmp_path / "d.onnx", sparse=False)}
    assert result(inf.embed(df, RunnerSpec("embed", "OnnxEmbedRunner", 12, dense)))[0] == ([16.0, 5.0], {})


def test_onnx_rerank(spark, tmp_path):
    kwargs = {
        "model_path": tiny_model(tmp_path / "r.onnx", logit=True), "tokenizer_path": tiny_tokenizer(tmp_path / "t.json"),
    }
    df = spark.createDataFrame([("red", "blue blue"), ("green", "")], "query string, text string")
    out = [r.score for r in inf.rerank(df, RunnerSpec("rerank", "OnnxRerankRunner", 12, kwargs)).collect()]
    # ids: 0 4 2 2 6 6 2 | 0 5 2 2 2
    assert out == pytest.approx([22 / 7, 11 / 5])


def test_gather_models_changes_placement_only(spark, docs):
    named = docs.withColumn("model", F.when(F.col("id") == 0, "default").otherwise("dense_only"))
    moved = inf.gather_models(named, "id", 5, 3)
    assert moved.columns == named.columns and moved.rdd.getNumPartitions() == 5
    assert result(inf.embed(moved, default_registry())) == result(inf.embed(named, default_registry()))


def test_onnx_fixed_shape_drops_its_fillers(spark, tmp_path):
    kwargs = {"model_path": tiny_model(tmp_path / "m.onnx"), "tokenizer_path": tiny_tokenizer(tmp_path / "t.json")}
    fixed = {**kwargs, "padding": "max_length", "max_length": 6, "truncation": True, "fixed_batch": True}
    df = spark.createDataFrame([(i, " ".join(["red", "blue"] * i)) for i in range(5)], "id bigint, text string")
    out = result(inf.embed(df, RunnerSpec("embed", "OnnxEmbedRunner", 3, fixed)))
    assert out == result(inf.embed(df, RunnerSpec("embed", "OnnxEmbedRunner", 4, fixed)))
    # ids: 0 2 | 0 4 6 2 | 0 4 6 4 6 2, and the same for every longer text
    assert [out[i][0] for i in range(5)] == [[2.0, 2.0], [12.0, 4.0]] + [[22.0, 6.0]] * 3


def test_head_outside_the_graph(spark, tmp_path):
    kwargs = {
        "model_path": tiny_model(tmp_path / "h.onnx", hidden=True), "tokenizer_path": tiny_tokenizer(tmp_path / "t.json"),
        "max_length": 8, "padding": "max_length",
    }
    spec = RunnerSpec("rerank", "OnnxPairEncoderRunner", 2, kwargs)
    df = spark.createDataFrame([(0, "red", "blue blue"), (1, "green", ""), (2, "red", "blue " * 40)], "id int, query string, text string")
    # ids: 0 4 2 2 6 6 2 | 0 5 2 2 2 | 0 4 2 2 6 6 6 2
    cls = np.array([[22.0], [11.0], [28.0]])
    w, b, wo, bo = [[0.1], [-0.02]], [0.0, 0.5], [1.0, 2.0], -0.25
    expected = np.tanh(cls @ np.array(w).T + b) @ np.array(wo) + bo
    head = inf.ScoreHead(w, b, wo, bo)
    out = {r.id: r.score for r in inf.rerank_encoded(df, spec, head).collect()}
    assert [out[i] for i in range(3)] == pytest.approx(expected.tolist())
    out = {r.id: r.score for r in inf.rerank_encoded(df, spec, head, normalize=True).collect()}
    assert [out[i] for i in range(3)] == pytest.approx((1 / (1 + np.exp(-expected))).tolist())


def test_length_order_keeps_results(docs):
    spec = RunnerSpec("embed", "HashedEmbedRunner", 2)
    ordered = inf.length_bucket_order(docs, partitions=1)
    lengths = [len(r.text.split()) for r in ordered.collect()]
    assert lengths[0] == 50 and ordered.columns == docs.columns
    assert result(inf.embed(ordered, spec)) == result(inf.embed(docs, spec))
