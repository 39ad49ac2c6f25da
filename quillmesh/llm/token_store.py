"""Token ids as ORC files in ascending document order, and reading them back.

ORC keeps the ids as run-length encoded integers in stripes; row indexes and Bloom filters on ``doc_id`` let a
reader skip stripes, and stripes are read in parallel. Each file is one range of ids, sorted, and rows carry the
number of ids before them, so a file or stripe can be used on its own.

Defined cases: null or empty text has the end id only; a null id comes first; rows that repeat an id follow each
other, ordered by text; an empty table makes a store without rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.ordered import bucket_bounds, bucket_of
from quillmesh.llm.tokens import encoder, with_end
from quillmesh.session import ship_package

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
STRIPE_BYTES = 64 << 20
INDEX_STRIDE = 10_000

SCHEMA = "doc_id bigint, bucket int, n_tokens bigint, before bigint, ids array<int>"


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for batch in batches:
            flat, offsets = with_end(*encoder(tokenizer).encode_column(batch.column("text")), end_id)
            bucket = np.asarray(batch.column("bucket"))
            starts = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
            base = np.repeat(offsets[:-1][starts], np.diff(np.append(starts, len(bucket))))
            before = offsets[:-1] - base
            if len(bucket) and bucket[0] == now:
                before[bucket == now] += total
            if len(bucket):
                now, total = bucket[-1], int(before[-1] + offsets[-1] - offsets[-2])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("bucket"), pa.array(np.diff(offsets)), pa.array(before), ids],
                names=["doc_id", "bucket", "n_tokens", "before", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, buckets: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` whole and write the store at ``path``.

    Documents are dealt into ranges of ids (one shuffle of the texts), encoded where they are sorted, and each range
    is written by one task. ``before`` counts from the beginning of its range; ``read_tokens`` adds the totals of the
    ranges before it, so no task waits for another.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = bucket_bounds(docs, "doc_id", buckets)
    dealt = docs.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    (
        dealt.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("orc.compress", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a store; ``start`` is the number of ids of all documents before it.

    The totals per range come from the files' small columns; there are as many as ranges, and they are joined as
    literals. A filter on ``doc_id`` reaches the ORC reader's indexes and Bloom filters.
    """
    stored = spark.read.schema(SCHEMA).orc(path)
    totals = stored.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()
    starts, base = {}, 0
    for row in totals:
        starts[row["bucket"]] = base
        base += row["n"]
    offsets = F.array(*[F.lit(starts.get(b, 0)).cast("bigint") for b in range(max(starts, default=0) + 1)])
    start = F.element_at(offsets, F.col("bucket") + 1) + F.col("before")
    return stored.select("doc_id", start.alias("start"), "n_tokens", "ids")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the checksum of the ids as little-endian unsigned 32-bit integers."""
    ship_package(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
