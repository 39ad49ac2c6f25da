"""Every catalogue query against its SQL statement on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from quillmesh.plans.catalog import CATALOG
from quillmesh.plans.oracles import ORACLES

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return str(value)


@pytest.fixture(scope="module")
def scattered(spark, data, tmp_path_factory):
    """The same tables as folders of several files, rows in another order."""
    folder = tmp_path_factory.mktemp("scattered")
    for name in TABLES:
        rows = spark.read.parquet(f"{data}/{name}.parquet").repartition(5)
        rows.sortWithinPartitions(rows.columns[0], ascending=False).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("layout", ["one_file", "many_files"])
@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, duck, data, scattered, name, layout):
    df = CATALOG[name](spark, data if layout == "one_file" else scattered)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    types = dict(zip(relation.columns, map(str, relation.types)))
    ours = dict(df.dtypes)
    assert {c: types[c] for c in columns} == {c: TYPES[ours[c]] for c in columns}
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    order = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in order) for r in relation.fetchall())
    assert got == want and got


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(CATALOG) == set(ORACLES)
    assert set(CATALOG) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_rerank_fallback_runs_no_python(spark, data):
    plan = CATALOG["rerank_fallback"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
