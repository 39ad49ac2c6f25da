"""Stored intermediate tables: settings hold for one job only, and its shuffle files go with it."""

import pytest
from pyspark.sql import functions as F

from quillmesh.session import materialize

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_batch_rows_hold_for_one_job(spark):
    def sizes_of(batches):  # nested, so that workers get it by value
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    before = spark.conf.get(BATCH), spark.conf.get(CLEANUP)
    sizes = spark.range(0, 500, 1, 1).mapInArrow(sizes_of, "n bigint")
    assert max(r.n for r in materialize(sizes, "sizes", 64).collect()) == 64
    assert (spark.conf.get(BATCH), spark.conf.get(CLEANUP)) == before
    assert max(r.n for r in materialize(sizes, "sizes").collect()) > 64


def test_settings_return_after_a_failure(spark):
    before = spark.conf.get(BATCH), spark.conf.get(CLEANUP)
    with pytest.raises(Exception, match="no such row"):
        materialize(spark.range(5).select(F.raise_error(F.lit("no such row")).cast("int").alias("x")), "broken", 8)
    assert (spark.conf.get(BATCH), spark.conf.get(CLEANUP)) == before


def test_a_stored_frame_can_be_used_again(spark):
    grouped = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count("*").alias("n"))
    first = sorted(map(tuple, grouped.collect()))
    assert sorted(map(tuple, materialize(grouped, "grouped").collect())) == first
    assert sorted(map(tuple, materialize(grouped, "grouped").collect())) == first
    assert sorted(map(tuple, grouped.collect())) == first
