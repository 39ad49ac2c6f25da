import json

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import requests as rq
from quillmesh.operators.runners import ModelRegistry, RunnerSpec, default_registry
from quillmesh.plans.serving import serve_embed, serve_rerank, serve_rewrite


def bodies(spark, values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "request_id bigint, body string")


def test_validate_embed(spark):
    good = [{"text": "a"}, {"text": ""}, {"text": ["a", "b"]}, {"text": "a", "model": "m", "return_sparse": True}]
    bad = [
        {}, {"text": []}, {"text": 1}, {"text": None}, {"text": ["a", 1]}, {"text": ["a", None]}, {"text": [["a"]]},
        {"text": "a", "model": 3}, {"text": "a", "model": None}, {"text": "a", "return_dense": "x"}, "{", "[1]", "7",
        '{"text":"a","text":3}',
    ]
    out = rq.validate_embed(bodies(spark, good + bad)).orderBy("request_id").collect()
    assert [r.status for r in out] == [None] * len(good) + [400] * len(bad)
    assert all(r.error.startswith("valid error: ") and r.error_stage == "validation" for r in out[len(good):])
    assert [(r.texts, r.scalar_input) for r in out[:3]] == [(["a"], True), ([""], True), (["a", "b"], False)]
    assert (out[0].model, out[0].return_dense, out[0].return_sparse) == ("default", True, False)
    assert (out[3].model, out[3].return_sparse) == ("m", True)


def test_unknown_keys_are_rejected_by_default(spark):
    df = bodies(spark, [{"text": "a", "extra": 1}])
    assert rq.validate_embed(df, strict=False).first().status is None
    row = rq.validate_embed(df).first()
    assert row.status == 400 and "extra" in row.error


def test_last_value_of_a_repeated_key_counts(spark):
    row = rq.validate_embed(bodies(spark, ['{"text":7,"text":"a","text":"b"}'])).first()
    assert row.status is None and row.texts == ["b"]
    row = rq.validate_rerank(bodies(spark, ['{"query":"x","texts":["a"],"query":"y"}'])).first()
    assert row.status is None and row["query"] == "y"


def test_validate_rerank(spark):
    good = [{"query": "q", "texts": ["a"]}, {"query": "", "texts": ["a", ""], "model": "m"}]
    bad = [{"texts": ["a"]}, {"query": 1, "texts": ["a"]}, {"query": "q", "texts": []}, {"query": "q", "texts": "a"},
           {"query": "q", "texts": ["a", None]}, {"query": "q"}]
    out = rq.validate_rerank(bodies(spark, good + bad)).orderBy("request_id").collect()
    assert [r.status for r in out] == [None] * 2 + [400] * len(bad)


def test_validate_rewrite(spark):
    good = [{"message": [["a"]]}, {"message": [["a", "b"], ["c"]], "model": "m"}]
    bad = [{"message": []}, {"message": [[]]}, {"message": [["a"], []]}, {"message": ["a"]}, {"message": [["a", 1]]},
           {"message": [["a", None]]}, {"message": [["a"], None]}, {}]
    out = rq.validate_rewrite(bodies(spark, good + bad)).orderBy("request_id").collect()
    assert [r.status for r in out] == [None] * 2 + [400] * len(bad)


def test_routing_and_capability_precedence(spark):
    df = bodies(spark, [
        {"text": 1, "model": "nope"}, {"text": "a", "model": "nope"}, {"text": "a", "model": "dense_only", "return_sparse": True},
        {"text": "a", "model": "sparse_only"}, {"text": "a", "model": "sparse_only", "return_dense": False},
        {"text": "a", "return_dense": False},
    ])
    out = serve_embed(df, default_registry()).orderBy("request_id").collect()
    assert [r.status for r in out] == [400, 400, 400, 400, 200, 200]
    assert out[1].error == "model name [nope] not found"
    assert out[2].error.startswith("param check error: ") and out[3].error.startswith("param check error: ")
    # Neither output requested: an answer without content.
    assert out[5].dense_embed is None and out[5].sparse_embed is None


def test_regroup_restores_requests(spark):
    df = spark.createDataFrame([("r1", ["x", "y", "z"]), ("r2", ["y"])], "request_id string, texts array<string>")
    rows = rq.explode_texts(df, spread=3).withColumns({
        "out": F.upper("text"), "status": F.lit(None).cast("int"), "error": F.lit(None).cast("string"),
    })
    back = {r.request_id: [x.out for x in r.results] for r in rq.regroup_results(rows, ["out"]).collect()}
    assert back == {"r1": ["X", "Y", "Z"], "r2": ["Y"]}


def test_regroup_fails_whole_request(spark):
    rows = spark.createDataFrame(
        [("a", 0, "x", None, None), ("a", 1, None, 500, "run exception: no"), ("b", None, None, 400, "valid error: no")],
        "request_id string, pos int, out string, status int, error string",
    )
    back = {r.request_id: (r.status, r.results) for r in rq.regroup_results(rows, ["out"]).collect()}
    assert back == {"a": (500, None), "b": (400, None)}


def test_layouts_agree(spark):
    df = bodies(spark, [{"text": ["a b", "c", ""], "return_sparse": True}, {"text": "z"}, {"text": 3}])
    reg = default_registry()
    nested = {r.request_id: r for r in serve_embed(df, reg, layout="requests").collect()}
    rows = serve_embed(df, reg).orderBy("request_id", "pos").collect()
    for rid in (0, 1):
        mine = [r for r in rows if r.request_id == rid]
        assert [r.dense_embed for r in mine] == nested[rid].dense_embed
        if rid == 0:
            assert [r.sparse_embed for r in mine] == nested[rid].sparse_embed
    assert nested[1].sparse_embed is None
    assert nested[2].status == 400 and nested[2].dense_embed is None
    assert len([r for r in rows if r.request_id == 2]) == 1


def test_serve_rerank_and_rewrite(spark):
    df = bodies(spark, [{"query": "a b", "texts": ["a b", "zz"]}, {"query": "a b", "texts": ["a b"], "model": "sigmoid"}])
    out = serve_rerank(df, default_registry()).orderBy("request_id", "pos").collect()
    assert out[0].score > out[1].score
    assert 0 < out[2].score < 1
    df = bodies(spark, [{"message": [["green tea please", "which one", "the second"], ["solo"]]}, {"message": [["x"]], "model": "no"}])
    out = serve_rewrite(df, default_registry()).orderBy("request_id", "pos").collect()
    assert [r.rewritten for r in out[:2]] == ["the second green please which", "solo"]
    assert (out[2].status, out[2].error) == (400, "model name [no] not found")


def test_registry_rejects_unknown_classes():
    with pytest.raises(ValueError):
        RunnerSpec("embed", "NoSuchRunner")
    with pytest.raises(ValueError):
        RunnerSpec("translate", "HashedEmbedRunner")
    with pytest.raises(TypeError):
        RunnerSpec("embed", "HashedEmbedRunner", kwargs={"batch_size": 3})
    assert ModelRegistry().specs("embed") == {}
