import math
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import lexical as lex
from quillmesh.operators import skew
from quillmesh.operators.skew import spread_join, spread_lookup
from quillmesh.plans import retrieval
from quillmesh.operators.runners import RunnerSpec

DOCS = ["the cat sat on the mat", "the dog", "", "cat cat dog bird", "the the the", "bird on a wire"]
QUERIES = ["the cat", "unknown bird", "wire wire dog", "?"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "item_id bigint, text string")


def words(text):
    return re.findall(r"\w+", text.lower())


def idf(token):
    df = sum(token in words(d) for d in DOCS)
    return math.log((len(DOCS) + 1) / (df + 1)) + 1


def weights(text):
    return {t: idf(t) / (1 + words(text).index(t) / 512) for t in set(words(text))}


def brute():
    out = {}
    for q, qt in enumerate(QUERIES):
        for d, dt in enumerate(DOCS):
            a, b = weights(qt), weights(dt)
            if a.keys() & b.keys():
                out[q, d] = sum(a[t] * b[t] for t in a.keys() & b.keys())
    return out


def test_fit_lexical(docs):
    got = {r.token: (r.df, r.idf) for r in lex.fit_lexical(docs).collect()}
    assert got["the"][0] == 3 and got["the"][1] == pytest.approx(idf("the"))
    assert set(got) == {t for d in DOCS for t in words(d)}


def test_lexical_weights_keep_empty_texts(docs):
    total = docs.agg(F.count(F.lit(1))).scalar()
    postings = lex.lexical_postings(docs, lex.fit_lexical(docs), total, "doc_id")
    maps = {r.doc_id: r.sparse_embed for r in lex.lexical_weights(postings, docs, "doc_id").collect()}
    assert maps[2] == {}
    assert sorted(maps[3].values()) == pytest.approx(sorted(weights(DOCS[3]).values()))


@pytest.mark.parametrize("small_chars", [10**6, 0])
def test_match_corpus_equals_brute_force_both_ways(docs, queries, small_chars):
    rows = retrieval.match_corpus(queries, docs, "item_id", "doc_id", small_chars).collect()
    assert {(r.item_id, r.doc_id): r.score for r in rows} == pytest.approx(brute())


def test_matrix_without_given_counts(spark):
    a = spark.createDataFrame([(1, 7, 2.0), (1, 8, 1.0), (2, 9, 1.0)], "l bigint, token_id bigint, weight double")
    b = spark.createDataFrame([(5, 7, 3.0), (5, 8, 0.5), (6, 1, 1.0)], "r bigint, token_id bigint, weight double")
    assert [tuple(r) for r in lex.lexical_score_matrix(a, b, "l", "r").collect()] == [(1, 5, 6.5)]


def test_top_k_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.7), (2, 1, 0.1)], "q bigint, d bigint, s double")
    rows = {(r.q, r["rank"]): r.d for r in retrieval.top_k(df, "q", "d", "s", 2).collect()}
    assert rows == {(1, 1): 4, (1, 2): 3, (2, 1): 1}


def test_retrieve_then_rerank_orders_by_reranker(docs, queries):
    rows = retrieval.retrieve_then_rerank(queries, docs, "item_id", "doc_id", RunnerSpec("rerank", "HeadRerankRunner"), k=2)
    for q in {r.item_id for r in rows.collect()}:
        mine = sorted((r for r in rows.collect() if r.item_id == q), key=lambda r: r.rerank_rank)
        assert [r.rerank_score for r in mine] == sorted((r.rerank_score for r in mine), reverse=True)
        assert len(mine) <= 2


def test_token_weights_long_and_id_to_token(spark):
    occ = spark.createDataFrame(
        [(1, 5, 0.5), (1, 5, 0.9), (1, 0, 3.0), (1, 6, -1.0), (2, 8, 0.1), (2, 9, 0.2)], "row_id bigint, token_id bigint, weight double"
    )
    best = lex.token_weights_long(occ, "row_id")
    assert {tuple(r) for r in best.collect()} == {(1, 5, 0.9), (2, 8, 0.1), (2, 9, 0.2)}
    vocab = spark.createDataFrame([(8, "same", 1), (9, "same", 1), (7, "x", 1)], "token_id bigint, token string, df bigint")
    assert [tuple(r) for r in lex.id_to_token(best, vocab, "row_id").collect()] == [(2, "same", 0.2)]


@pytest.mark.parametrize("per_task", [1, 3, 1000])
def test_spread_lookup_splits_hot_keys_exactly(spark, per_task):
    left = spark.range(50).select("id", F.when(F.col("id") < 30, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    out = spread_lookup(left, right, "k", "n", ["id"], rows_per_task=per_task)
    assert sorted((r.id, r.k, r.v) for r in out.collect()) == sorted((r.id, r.k, len(r.k)) for r in left.collect())


@pytest.mark.parametrize("most", [1, 2, 3])
def test_hot_lists_have_a_size_bound(spark, monkeypatch, most):
    """However small the budget of a task, fewer keys than ``MAX_HOT`` are dealt out, and the join stays exact."""
    monkeypatch.setattr(skew, "MAX_HOT", most)
    left = spark.range(90).select("id", (F.col("id") % 9).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    budget = skew._budget(right, F.col("n"), 1)
    assert right.where(F.col("n") > budget).count() <= most
    out = spread_lookup(left, right, "k", "n", ["id"], rows_per_task=1)
    assert sorted((r.id, r.k) for r in out.collect()) == [(i, i % 9) for i in range(90)]


@pytest.mark.parametrize(("pairs_per_task", "rows_per_task"), [(4, 3), (50, 10**6), (10**9, 5), (10**9, 10**6)])
def test_spread_join_equals_plain_join(spark, pairs_per_task, rows_per_task):
    a = spark.range(60).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    b = spark.range(40).select(F.col("id").alias("b"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5).alias("k"))
    rows = a.groupBy("k").agg(F.count(F.lit(1)).alias("n_left")).join(b.groupBy("k").agg(F.count(F.lit(1)).alias("n_right")), "k")
    out = spread_join(a, b, "k", "a", "b", rows, pairs_per_task, rows_per_task)
    assert sorted((r.a, r.b) for r in out.collect()) == sorted((r.a, r.b) for r in a.join(b, "k").collect())


def test_matrix_sums_have_as_many_tasks_as_pairs_need(spark):
    """40,000 pairs, 1,000 a task: 40 tasks add cells up although the session asks for fewer."""
    a = spark.range(200).select(F.col("id").alias("l"), F.explode(F.array(F.lit(1), F.lit(2))).alias("token_id"), F.lit(2.0).alias("weight"))
    b = spark.range(100).select(F.col("id").alias("r"), F.explode(F.array(F.lit(1), F.lit(2))).alias("token_id"), F.lit(0.5).alias("weight"))
    out = lex.lexical_score_matrix(a, b, "l", "r", pairs_per_task=1000)
    cells = out.select("*", F.spark_partition_id().alias("task")).collect()
    assert len(cells) == 20_000 and {c.score for c in cells} == {2.0}
    assert len({c.task for c in cells}) > 30


def test_matrix_pairs_are_not_held_by_the_join(spark):
    """Below the session's number of tasks, too: the join's tasks add nothing up, the sums' tasks get equal parts."""
    a = spark.range(200).select(F.col("id").alias("l"), F.explode(F.array(F.lit(1), F.lit(2))).alias("token_id"), F.lit(2.0).alias("weight"))
    b = spark.range(100).select(F.col("id").alias("r"), F.explode(F.array(F.lit(1), F.lit(2))).alias("token_id"), F.lit(0.5).alias("weight"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = lex.lexical_score_matrix(a, b, "l", "r", pairs_per_task=4000)
        cells = out.select("*", F.spark_partition_id().alias("task")).collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(cells) == 20_000 and {c.score for c in cells} == {2.0}
    assert len({c.task for c in cells}) == 10
    final = plan.split("Initial Plan")[0]
    assert max(line for line, text in enumerate(final.splitlines()) if "HashAggregate(keys=[l#" in text) < final.split("hashpartitioning(l#")[0].count("\n")
