"""Session helpers: tuned defaults, worker-side packaging, shared scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sides whose measured size turns out small may still be broadcast at run time.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # Texts reach 100+ KB: keep the Arrow batches handed to the runners small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def get_session(app: str = "quillmesh", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the library defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (same effect as ``--py-files``)."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmesh_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quillmesh-"), "quillmesh.zip")
    with zipfile.ZipFile(archive, "w") as zf:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.join("quillmesh", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._quillmesh_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Without that setting only a local session goes on, as in tests: there one machine runs everything, and one
    folder serves the whole session. A cluster session without it is an error, as executors would write to
    disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark.sparkContext, "_quillmesh_scratch", None) or tempfile.mkdtemp(prefix="quillmesh-")
        spark.sparkContext._quillmesh_scratch = base
    return f"{base.rstrip('/')}/quillmesh/{name}-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Some settings for the jobs run inside; those that this Spark does not know are left out."""
    before = {key: old for key in wanted if (old := spark.conf.get(key, None)) is not None}
    for key in before:
        spark.conf.set(key, wanted[key])
    try:
        yield
    finally:
        for key, old in before.items():
            spark.conf.set(key, old)


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    For results that are costly (a model has run) and used more than once: recomputing them would
    run the model again, and the copy survives the loss of executors. The shuffle files of the writing
    job go at its end, as nothing reads them any more. ``batch_rows`` bounds the Arrow batches of this
    one job, for Python steps over whole texts in sessions with Spark's own default.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(key))
        wanted[key] = str(min(batch_rows, now) if now > 0 else batch_rows)
    with _settings(spark, wanted):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
