"""Sources: driver tables, request bodies, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.text import clean_html, strip

REQUEST_SCHEMA = "request_id bigint, body string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; the name may be a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_target(df: DataFrame) -> int | None:
    """Number of cores, if the table is stored in fewer pieces than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if df.rdd.getNumPartitions() < cores else None


def spread_out(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a table that is stored in too few pieces.

    A table with at least as many scan partitions as there are cores is returned as it is, so
    large tables are never shuffled for this.
    """
    cores = spread_target(df)
    return df.repartition(cores) if cores else df


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | str, **options: str) -> DataFrame:
    """The same table as a file stream. The glob matches a single file as well as a folder."""
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(f"{folder}/{name}.parque[t]")


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw request bodies ``request_id, body``, from Parquet or JSON lines."""
    return spark.read.format(fmt).schema(REQUEST_SCHEMA).load(path)


def read_request_lines(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies from JSON lines, ``request_id, body, source_file, corrupt_line``.

    A line that is no JSON object, or whose fields have other types, is kept: its text is in ``corrupt_line``, id and
    body are null.
    """
    kinds = f"{REQUEST_SCHEMA}, corrupt_line string"
    rows = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt_line").json(path)
    sound = F.col("corrupt_line").isNull()
    return rows.select(
        F.when(sound, F.col("request_id")).alias("request_id"), F.when(sound, F.col("body")).alias("body"),
        F.col("_metadata.file_name").alias("source_file"), "corrupt_line",
    )


def stream_requests(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """The same bodies as a file stream."""
    reader = spark.readStream.format(fmt).schema(REQUEST_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def retrieval_dataset(
    queries: DataFrame, corpus: DataFrame, query_text: str = "text", corpus_text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Query texts stripped, corpus texts cleaned of mark-up."""
    return (
        queries.withColumn(query_text, strip(F.col(query_text))),
        corpus.withColumn(corpus_text, clean_html(F.col(corpus_text))),
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A result table written by ``write_results``. A missing path is an error."""
    return spark.read.parquet(path)
