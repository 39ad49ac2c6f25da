"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import evaluation as ev
from quillmesh.operators import latency as lat
from quillmesh.operators import requests as rq
from quillmesh.plans import fixtures as fx
from quillmesh.plans.catalog import CATALOG
from quillmesh.sources.tables import spread_out, table

STREAMS = {n for n in CATALOG if n.endswith("_stream")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(CATALOG) - STREAMS))
def test_no_products(spark, data, name):
    text = plan(CATALOG[name](spark, data))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_scans_read_only_what_is_needed(spark, data):
    text = plan(lat.request_counter(fx.request_log(table(spark, data, "events"))))
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", text)[1])) == {"event_type", "user_id"}


def test_log_statistics_do_not_sort_the_log(spark, data):
    text = plan(lat.latency_stats(fx.latency_log(table(spark, data, "events"))))
    for node in re.findall(r"SortAggregate\(.*", text):
        assert "latency_ms" not in node and "avg" not in node


def test_row_operators_do_not_shuffle(spark, data):
    docs, embeddings = table(spark, data, "documents"), table(spark, data, "embeddings")
    for df in (
        rq.validate_embed(fx.embed_requests(docs)),
        fx.position_weights(docs, "doc_id"),
        ev.compare_dense(fx.dense_pairs(embeddings), "a", "b"),
        ev.compare_sparse(fx.sparse_pairs(docs), "a", "b"),
    ):
        assert "Exchange" not in plan(df)


@pytest.mark.parametrize("which", ["parse", "compare"])
def test_filters_do_not_repeat_the_work(spark, data, which):
    docs = table(spark, data, "documents")
    if which == "parse":
        df, word = rq.validate_embed(fx.embed_requests(docs)).where(F.col("status").isNull()), "parse_json"
    else:
        df, word = ev.compare_sparse(fx.sparse_pairs(docs), "a", "b").where(F.col("common_keys_count") > 0), "md5"
    for node in re.findall(r"Filter .*", plan(df)):
        assert word not in node


def test_spread_out_leaves_large_tables_alone(spark, data):
    many = table(spark, data, "documents").repartition(64)
    assert spread_out(many) is many
    assert spread_out(many.coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
