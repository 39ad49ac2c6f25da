"""Requests whose answers arrive in pieces, in any order and over any number of micro-batches, put together again.

The state of a request is one entry per position that has arrived; it is given up as soon as the last one is there, or
when its event-time timer runs out. Requests are spread over tasks by their id, and a task holds the pieces of one request that came in
one micro-batch, or the answer it emits, which is as large as one request was. Pieces that complete a request are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillmesh.operators.requests import RUN_PREFIX
from quillmesh.streaming.jobs import start_append

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT = "30 seconds"
OUTPUT = "request_id string, results array<string>, status int, error string"


class GatherPieces(StatefulProcessor):
    """Keyed by request: emits when all positions are there, or a 500 row when the watermark has passed its last piece."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "pos int", "answer string, error string")
        self.progress = handle.getValueState("progress", "positions array<int>, total int, failed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.progress.exists()
        positions, total, failed = self.progress.get() if held else ([], 0, False)
        latest, arrived = 0, {}
        for row in rows:
            latest = max(latest, int(row.arrived_ms))
            # a piece that comes twice replaces itself
            arrived[int(row.pos)] = (row.answer, row.error)
            total, failed = max(total, int(row.n_texts)), failed or row.error is not None
        if held:
            for timer in list(self.handle.listTimers()):
                latest = max(latest, timer)
                self.handle.deleteTimer(timer)
        seen = {*positions, *arrived}
        if len(seen) >= total:
            # the last pieces need not be stored; a request that came at once has no state at all
            yield self._emit(key, None, arrived, held)
        else:
            for pos, value in arrived.items():
                self.answers.updateValue((pos,), value)
            self.progress.update((sorted(seen), total, failed))
            self.handle.registerTimer(latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        positions, total, _ = self.progress.get()
        yield self._emit(key, f"{RUN_PREFIX}{len(positions)} of {total} answers arrived", {}, True)

    def _emit(self, key, error: str | None, arrived: dict, held: bool) -> Row:
        if held:
            arrived = {pos: value for (pos,), value in self.answers.iterator()} | arrived
            self.answers.clear()
            self.progress.clear()
        found = sorted((pos, *value) for pos, value in arrived.items())
        errors = [e for _, _, e in found if e is not None]
        error = error or (max(errors) if errors else None)
        results = None if error else [answer for _, answer, _ in found]
        return Row(request_id=key[0], results=results, status=500 if error else 200, error=error)

    def close(self) -> None:
        pass


def regroup_stream(pieces: DataFrame, wait: str = WAIT) -> DataFrame:
    """``request_id, results array<string>, status, error`` of a stream of pieces.

    ``pieces`` is ``request_id, pos, n_texts, answer, error, arrived_at``: one row per position, each with the number of texts of
    its request. Results are in the order of positions; a failed piece fails its request. The watermark trails the latest arrival
    by ``wait``: a request whose last piece is older than that is given up as a 500 row, and a piece that comes later still
    is not waited for. Start it with ``start_regroup``.
    """
    text = {c: F.col(c).cast("string").alias(c) for c in ("request_id", "answer", "error")}
    number = {c: F.col(c).cast("int").alias(c) for c in ("pos", "n_texts")}
    arrived = F.col("arrived_at").cast("timestamp")
    rows = pieces.select(*text.values(), *number.values(), arrived.alias("arrived_at"), F.unix_millis(arrived).alias("arrived_ms"))
    return rows.withWatermark("arrived_at", wait).groupBy("request_id").transformWithState(
        statefulProcessor=GatherPieces(), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state needs the RocksDB store; a query keeps the setting it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def start_regroup(answers: DataFrame, path: str, checkpoint: str, processing_time: str | None = None) -> StreamingQuery:
    """Append regrouped answers to Parquet. Without an interval: all available input, then stop."""
    with rocksdb_state(answers.sparkSession):
        return start_append(answers, path, checkpoint, processing_time)
