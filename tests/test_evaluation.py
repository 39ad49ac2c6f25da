import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import evaluation as ev
from quillmesh.operators import reports

NAN, INF = float("nan"), float("inf")


def same(a, b):
    return (a == b) or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b)


def test_compare_dense_handles_missing_and_mismatched(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0], [1.0, 2.0]), (3, None, [1.0]), (4, [0.0], [1.0])],
        "id int, a array<float>, b array<double>",
    )
    out = {r.id: r for r in ev.compare_dense(df, "a", "b").collect()}
    assert set(out) == {1, 2, 4}
    assert out[1].cosine_similarity == 1.0 and not out[1].shape_mismatch
    assert out[2].shape_mismatch and out[2].mse is None
    assert math.isnan(out[4].cosine_similarity)
    with pytest.raises(Exception, match="different length"):
        ev.compare_dense(df, "a", "b", strict=True).collect()


def test_sparse_forms_agree(spark):
    rows = [(1, {1: 0.5, 2: 1.0}, {2: 0.5, 3: 1.0}), (2, {1: 1.0}, {5: 1.0}), (3, {}, {}), (4, {7: 0.25}, {})]
    df = spark.createDataFrame(rows, "sample_id bigint, a map<bigint,double>, b map<bigint,double>")
    wide = {r.sample_id: r for r in ev.compare_sparse(df, "a", "b").collect()}
    sides = [df.select("sample_id", F.explode(c).alias("token_id", "weight")) for c in ("a", "b")]
    long = {r.sample_id: r for r in ev.compare_sparse_long(*sides, df).collect()}
    names = ev.SPARSE_METRICS + ("common_keys_count", "generated_keys_count", "reference_keys_count")
    for i in range(1, 5):
        assert [wide[i][n] for n in names] == [long[i][n] for n in names]
    assert (wide[3].jaccard_similarity, wide[3].value_mse) == (0.0, INF)
    assert wide[1].jaccard_similarity == pytest.approx(1 / 3) and wide[1].value_mae == 0.5


def test_compare_scores_against_numpy(spark):
    rng = np.random.default_rng(4)
    samples = {i: (rng.normal(size=6), rng.normal(size=6)) for i in range(4)}
    samples[10] = (np.array([0.3]), np.array([0.9]))
    samples[11] = (np.array([0.5, 0.5, 0.5]), np.array([0.1, 0.2, 0.3]))
    samples[12] = (np.array([0.1, 0.2, 0.7, 9.0]), np.array([0.2, 0.4]))
    samples[13] = (np.array([1.0, 2.0]), np.array([]))

    def table(side):
        rows = [(i, p, float(v)) for i, s in samples.items() for p, v in enumerate(s[side])]
        return spark.createDataFrame(rows, "sample_id bigint, pos int, score double")

    out = {r.sample_id: r for r in ev.compare_scores(table(0), table(1)).collect()}
    assert set(out) == set(samples) - {13}
    for i, r in out.items():
        n = min(map(len, samples[i]))
        g, f = samples[i][0][:n], samples[i][1][:n]
        assert r.score_count == n
        assert r.mse == pytest.approx(np.mean((g - f) ** 2)) and r.mae == pytest.approx(np.mean(np.abs(g - f)))
        with np.errstate(all="ignore"):
            expected = np.corrcoef(g, f)[0, 1] if n > 1 else 1.0
        assert same(r.correlation, float(expected))


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0], [3.0], [1.0, NAN, -2.0], [1.0, INF]])
def test_summarize_like_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "m double")
    r = ev.summarize(df, ["m"], "x").first()
    with np.errstate(all="ignore"):
        expected = [float(f(values)) for f in (np.mean, np.std, np.min, np.max)]
    assert all(same(a, b) for a, b in zip((r["mean"], r["std"], r["min"], r["max"]), expected))
    assert r.samples == len(values)


def test_summary_of_nothing_has_no_rows(spark):
    assert ev.summarize(spark.createDataFrame([], "m double"), ["m"], "x").count() == 0


def test_alignment_report(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "sample_id int")
    b = spark.createDataFrame([(2,), (3,)], "sample_id int")
    assert tuple(ev.alignment_report(a, b, ["sample_id"]).first()) == (3, 2, 2, True)
    assert tuple(ev.alignment_report(a, a, ["sample_id"]).first()) == (3, 3, 3, False)


def test_compare_embeddings_skips_fields_not_samples(spark):
    schema = "sample_id int, dense_embed array<float>, sparse_embed map<bigint,double>"
    gen = spark.createDataFrame([(1, [1.0], {1: 1.0}), (2, None, {1: 1.0}), (3, [1.0], None), (9, [1.0], {})], schema)
    ref = spark.createDataFrame([(1, [1.0], {1: 1.0}), (2, [1.0], {1: 1.0}), (3, [1.0], {1: 1.0})], schema)
    dense, sparse = ev.compare_embeddings(gen, ref)
    assert {r.sample_id for r in dense.collect()} == {1, 3}
    assert {r.sample_id for r in sparse.collect()} == {1, 2}


def test_backend_parity(spark):
    rows = [
        (0, [2], [1.0, 2.0], [2], [1.0, 2.0]),
        (1, [2], [1.0, 2.0], [2], [0.5, 1.5]),
        (2, [2], [5.0, 2.0], [2], [1.0, 2.0]),
        (3, [2], [1.0, 2.0], [1], [1.0]),
        (4, [2], [1.0, NAN], [2], [1.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, "i int, shape_a array<int>, data_a array<double>, shape_b array<int>, data_b array<double>")
    out = {r.i: r for r in ev.backend_parity(df, ["i"]).collect()}
    assert [out[i].passed for i in range(4)] == [True, True, False, False]
    assert out[1].max_abs_err == 0.5 and out[1].mean_abs_err == 0.5
    assert out[3].max_abs_err is None and not out[3].shape_match
    assert ev.all_passed(ev.backend_parity(df, ["i"])).first()[0] is False
    tight = {r.i: r.passed for r in ev.backend_parity(df, ["i"], rtol=1e-3).collect()}
    assert tight[0] and not tight[1]


def summary(spark, cos=None, corr=None):
    rows = []
    if cos is not None:
        rows += [("dense", m, 1, cos, 0.0, cos, cos) for m in ev.DENSE_METRICS]
    if corr is not None:
        rows += [("rerank", m, 1, corr, 0.0, corr, corr) for m in ev.SCORE_METRICS]
    return spark.createDataFrame(rows, "kind string, metric string, samples bigint, mean double, std double, min double, max double")


@pytest.mark.parametrize(
    ("cos", "corr", "label", "start"),
    [
        (0.95, 0.9, "GOOD", "✅ Results look GOOD"),
        (0.95, None, "GOOD", "✅ Embedding results look GOOD"),
        (None, 0.9, "GOOD", "✅ Reranker results look GOOD"),
        (0.5, None, "ATTENTION", "❌ Embedding results need ATTENTION"),
        (None, 0.5, "ATTENTION", "❌ Reranker results need ATTENTION"),
        (0.5, 0.5, "ATTENTION", "❌ Results need ATTENTION"),
        (0.95, 0.5, "MIXED", "⚠️  Results are MIXED"),
        (0.5, 0.9, "MIXED", "⚠️  Results are MIXED"),
        (NAN, NAN, "GOOD", "✅ Results look GOOD"),
        (0.9, 0.8, "GOOD", "✅ Results look GOOD"),
        (None, None, "NOT EVALUATED", "Nothing"),
    ],
)
def test_verdict(spark, cos, corr, label, start):
    row = reports.verdict(summary(spark, cos, corr)).first()
    assert row.label == label and row.message.startswith(start)


def test_evaluation_report_lines(spark):
    lines = [r.line for r in reports.evaluation_report(summary(spark, 0.95)).orderBy("line_no").collect()]
    assert lines[0] == "=" * 80 and "  Cosine Similarity: 0.9500 ± 0.0000" in lines
    assert not any("RERANKER" in x for x in lines)
    assert lines[-2].endswith("(Cosine Similarity: 0.9500)")
