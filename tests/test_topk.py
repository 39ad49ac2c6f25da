"""Bounded top-k against full scoring."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import topk
from quillmesh.plans.retrieval import match_corpus, top_k
from quillmesh.sources.tables import table


def tables(spark, seed, n_docs=120, n_queries=8):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    def text(n):
        return " ".join(words[min(int(dice.expovariate(0.12)), 59)] for _ in range(n))
    docs = [(i, text(dice.randrange(0, 90))) for i in range(n_docs)] + [(n_docs, None), (n_docs + 1, "w1 w2"), (n_docs + 2, "w1 w2")]
    asked = [(i, text(dice.randrange(1, 9))) for i in range(n_queries)] + [(n_queries, "unheard"), (n_queries + 1, ""), (n_queries + 2, None)]
    kinds = "{} bigint, text string, score string"
    extra = lambda rows: [(*r, "x") for r in rows]
    return spark.createDataFrame(extra(asked), kinds.format("q")), spark.createDataFrame(extra(docs), kinds.format("d"))


def rounded(df):
    return sorted((r.q, r["rank"], r.d, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 5), (3, 200)])
def test_equal_to_full_scoring(spark, seed, k):
    queries, docs = tables(spark, seed)
    got = topk.lexical_top_k(queries, docs, "q", "d", k, digits=6)
    scores = match_corpus(queries, docs, "q", "d").withColumn("score", F.round("score", 6) + F.lit(0.0))
    assert rounded(got) == rounded(top_k(scores, "q", "d", "score", k)) != []


def test_empty_tables(spark):
    queries, docs = tables(spark, 4)
    assert topk.lexical_top_k(queries.limit(0), docs, "q", "d").count() == 0
    assert topk.lexical_top_k(queries, docs.limit(0), "q", "d").count() == 0


def test_rest_bounds_every_unread_document(spark):
    queries, docs = tables(spark, 5)
    postings, terms = topk.posting_blocks(queries, docs, "q", "d")
    bounds = topk.block_bounds(postings, terms, "q").collect()
    by_doc = {}
    for p in postings.collect():
        by_doc.setdefault(p.d, {})[p.token] = (p.block, p.weight)
    for q in {b.q for b in bounds}:
        own = sorted((b for b in bounds if b.q == q), key=lambda b: (-b.bound, b.block))
        for i, b in enumerate(own):
            unread = {x.block: x.weight for x in own[i:]}
            most = max(sum(unread[bl] * w for bl, w in doc.values() if bl in unread) for doc in by_doc.values())
            assert most <= b.rest + 1e-9


def test_few_cells_are_read(spark, data):
    """Of the cells a full matrix holds, blocks that bounds allow to skip are not read; candidates are a small part."""
    queries, docs = table(spark, data, "benchmark"), table(spark, data, "documents")
    postings, terms = topk.posting_blocks(queries, docs, "item_id", "doc_id")
    pairs, read = topk.candidates(postings, terms, "item_id", "doc_id", 10)
    full = terms.join(postings.select("token"), "token").count()
    assert read.agg(F.sum("rows")).first()[0] < full
    assert pairs.count() < queries.count() * docs.count()
