import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import vectors as vx


def test_token_weights(spark):
    rows = [
        ([0, 5, 7, 5, 2], [1.0, 0.5, 0.2, 0.9, 1.0]),
        ([5, 6], [0.0, -1.0]),
        ([], []),
        ([1, 3], [1.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "i array<bigint>, w array<double>")
    got = [r[0] for r in df.select(vx.token_weights(F.col("i"), F.col("w"))).collect()]
    assert got == [{5: 0.9, 7: 0.2}, {}, {}, {}]


def test_trim_colbert(spark):
    vecs = [[float(i)] for i in range(4)]
    rows = [(vecs, [1, 1, 1, 0]), (vecs, [1, 0, 0, 0]), (vecs, [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "v array<array<double>>, m array<int>")
    got = [r[0] for r in df.select(vx.trim_colbert(F.col("v"), F.col("m"))).collect()]
    assert got == [[[0.0], [1.0]], [], []]


def test_lexical_score_and_sparse_metrics_against_python(spark):
    rng = np.random.default_rng(1)
    rows = [({}, {}), ({1: 1.0}, {}), ({1: 1.0}, {2: 1.0}), ({1: 2.0, 3: 0.5}, {3: 4.0, 1: 1.5})]
    for _ in range(20):
        rows.append(tuple({int(k): float(rng.random()) for k in rng.integers(0, 30, 15)} for _ in range(2)))
    df = spark.createDataFrame(rows, "a map<bigint,double>, b map<bigint,double>")
    out = df.select(
        "a", "b", vx.lexical_score(F.col("a"), F.col("b")).alias("s"), vx.sparse_metrics(F.col("a"), F.col("b")).alias("m")
    )
    for r in out.collect():
        common = r.a.keys() & r.b.keys()
        union = r.a.keys() | r.b.keys()
        assert r.s == pytest.approx(sum(r.a[k] * r.b[k] for k in common))
        assert r.m.jaccard_similarity == pytest.approx(len(common) / len(union) if union else 0.0)
        assert (r.m.common_keys_count, r.m.generated_keys_count, r.m.reference_keys_count) == (
            len(common), len(r.a), len(r.b),
        )
        diffs = [r.a[k] - r.b[k] for k in common]
        if common:
            assert r.m.value_mse == pytest.approx(np.mean(np.square(diffs)))
            assert r.m.value_mae == pytest.approx(np.mean(np.abs(diffs)))
        else:
            assert math.isinf(r.m.value_mse) and math.isinf(r.m.value_mae)


def test_lexical_score_is_symmetric(spark):
    df = spark.createDataFrame([({1: 0.1, 2: 0.7}, {2: 0.3, 9: 5.0})], "a map<bigint,double>, b map<bigint,double>")
    r = df.select(vx.lexical_score(F.col("a"), F.col("b")), vx.lexical_score(F.col("b"), F.col("a"))).first()
    assert r[0] == r[1]


def test_dense_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=8).tolist(), rng.normal(size=8).tolist()) for _ in range(10)]
    rows += [([0.0] * 3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for r in df.select("a", "b", vx.dense_metrics(F.col("a"), F.col("b")).alias("m")).collect():
        a, b = np.array(r.a), np.array(r.b)
        norms = np.linalg.norm(a) * np.linalg.norm(b)
        if norms:
            assert r.m.cosine_similarity == pytest.approx(a @ b / norms)
        else:
            assert math.isnan(r.m.cosine_similarity)
        assert r.m.euclidean_distance == pytest.approx(np.linalg.norm(a - b))
        assert r.m.l2_norm_difference == pytest.approx(abs(np.linalg.norm(a) - np.linalg.norm(b)))
        assert r.m.mse == pytest.approx(np.mean((a - b) ** 2))
        assert r.m.mae == pytest.approx(np.mean(np.abs(a - b)))


def test_sigmoid_does_not_overflow(spark):
    df = spark.createDataFrame([(0.0,), (800.0,), (-800.0,)], "x double")
    assert [r[0] for r in df.select(vx.sigmoid(F.col("x"))).collect()] == [0.5, 1.0, 0.0]


def test_score_head_and_udf_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    w, b, wo, bo = rng.normal(size=(5, 6)), rng.normal(size=5), rng.normal(size=5), 0.25
    cls = rng.normal(size=(7, 6))
    df = spark.createDataFrame([(c.tolist(),) for c in cls], "c array<double>")
    expected = np.tanh(cls @ w.T + b) @ wo + bo
    out = df.select(
        vx.score_head(F.col("c"), w.tolist(), b.tolist(), wo.tolist(), bo).alias("x"),
        vx.score_head_udf(w, b, wo, bo)(F.col("c")).alias("y"),
    ).collect()
    assert [r.x for r in out] == pytest.approx(expected.tolist())
    assert [r.y for r in out] == pytest.approx(expected.tolist())
