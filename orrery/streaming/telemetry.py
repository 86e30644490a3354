"""Telemetry of streams: a listener that writes a row for each micro-batch to a table, with gauges of the driver's process.

Rows are gathered where Spark reports them and appended ``every`` rows and when a stream ends, so the table has one
small file for many batches, and reporting never waits for a write of each. The table is plain Parquet: read it with Spark, or as a
stream of its own.
"""

from __future__ import annotations

import json
import resource
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = (
    "at double, event string, query string, name string, batch long, input_rows long, rows_per_second double, trigger_ms long, watermark string, state_rows long, state_bytes long, "
    "late_rows long, error string, cpu_seconds double, peak_mb double"
)


def gauges() -> tuple[float, float]:
    """(CPU seconds, peak MB) of this process."""
    u = resource.getrusage(resource.RUSAGE_SELF)
    return u.ru_utime + u.ru_stime, u.ru_maxrss / 1024


class ProgressTable(StreamingQueryListener):
    """Writes to ``path``; only of streams whose name is in ``names``, if given."""

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...] = (), every: int = 100) -> None:
        self.spark, self.path, self.names, self.every = spark, path, names, every
        self.rows: list[tuple] = []
        self.known: dict[str, str] = {}
        self.ended: set[str] = set()
        self.lock = threading.Lock()

    def add(self, event: str, query: str, *rest) -> None:
        if self.names and self.known.get(query) not in self.names:
            return
        with self.lock:
            self.rows.append((time.time(), event, query, self.known.get(query), *rest, *gauges()))
            full = len(self.rows) >= self.every
        if full:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        self.known[str(event.id)] = event.name
        self.add("started", str(event.id), *[None] * 9)

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = p.get("stateOperators", [])
        total = lambda key: sum(s.get(key, 0) for s in state)
        self.add("progress", p["id"], p["batchId"], p["numInputRows"], p.get("processedRowsPerSecond", 0.0), p.get("durationMs", {}).get("triggerExecution", 0), p.get("eventTime", {}).get("watermark"), total("numRowsTotal"), total("memoryUsedBytes"), total("numRowsDroppedByWatermark"), None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.add("ended", str(event.id), *[None] * 8, event.exception)
        self.flush()
        self.ended.add(self.known.get(str(event.id)))


@contextmanager
def recorded(spark: SparkSession, path: str, *names: str, wait: float = 30.0) -> Iterator[None]:
    """Records the named streams that run inside the block; waits until the listener has seen their ends."""
    listener = ProgressTable(spark, path, names)
    spark.streams.addListener(listener)
    try:
        yield
        until = time.time() + wait
        while set(names) - listener.ended and time.time() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(listener)
        listener.flush()


def summary(rows: DataFrame) -> DataFrame:
    """(name, batches, input_rows, late_rows, failed) of each stream's last run in the table."""
    p = F.col("event") == "progress"
    return rows.groupBy("query").agg(
        F.max("name").alias("name"), F.count_if(p & (F.col("input_rows") > 0)).alias("batches"), F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.sum("late_rows"), F.lit(0)).alias("late_rows"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    ).drop("query")


def q_stream_telemetry(spark, d):
    """The rows that a windowed stream over all events read, as its telemetry has them."""
    from orrery.sources.scratch import Scratch
    from orrery.streaming.windows import events, tumbling

    with Scratch(spark) as s:
        path, name = s.path("telemetry"), f"telemetry-{time.time_ns()}"
        with recorded(spark, path, name):
            g = tumbling(events(spark, d), "1 hour")
            g.writeStream.queryName(name).outputMode("update").format("noop").option("checkpointLocation", s.path("state")).trigger(availableNow=True).start().awaitTermination()
        return s.kept(summary(spark.read.schema(SCHEMA).parquet(path)).select("input_rows", "late_rows", "failed"))


QUERIES = {"stream_telemetry": q_stream_telemetry}
ORACLE_SQL = {"stream_telemetry": "select count(*) as input_rows, 0::bigint as late_rows, 0::bigint as failed from events"}
