"""The proximity cache as keyed stream state: map state for what is stored, ordered by event time, bounded, expiring.

A key's rows wait in map state until the watermark has passed them; a timer then replays them by (time, id), so the
answers do not depend on how the rows fell into micro-batches or in which order they came within the watermark's
delay. Rows later than that are dropped by Spark. What the cache holds is map state by entry, at most ``capacity`` of
them: a replay reads the entries once and writes those that were made, used or evicted. With ``idle_ms`` another timer
clears a key that nobody asked for in that long (of event time). A session needs the RocksDB state store; ``state_store`` sets it and
sets the caller's back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from orrery.operators.cache import ProximityCache
from orrery.sources.tables import table
from orrery.streaming.windows import drained, events

ANSWERS = "key long, id long, at long, value long, hit boolean, source long"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class CacheProcessor(StatefulProcessor):
    """Rows (key, id, at in microseconds, value, v) to ANSWERS: whether a stored vector within the tolerance answers, and whose value it is."""

    def __init__(self, capacity: int, tolerance: float, policy: str, idle_ms: int | None = None) -> None:
        ProximityCache(capacity, tolerance, policy)  # raises on bad values
        if policy not in ("fifo", "lru"):
            raise ValueError(f"a key's cache is fifo or lru, not {policy!r}")
        self.capacity, self.tolerance, self.policy, self.idle_ms = capacity, tolerance, policy, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id long", "value long, v array<double>")
        self.entries = handle.getMapState("entries", "number long", "used long, value long, v array<double>")
        self.count = handle.getValueState("count", "made long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            for i, at, value, v in zip(frame["id"], frame["at"], frame["value"], frame["v"], strict=True):
                self.waiting.updateValue((int(at), int(i)), (int(value), [float(x) for x in v]))
                last = max(last or int(at), int(at))
        if last is not None:
            self.handle.registerTimer(last // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted(k for k in self.waiting.keys() if k[0] // 1000 <= now)
        made, last = self.count.get() if self.count.exists() else (0, 0)
        if not due:
            if self.idle_ms is not None and last // 1000 + self.idle_ms <= now:
                self.entries.clear()
                self.count.clear()
            return iter(())
        stored = {k[0]: v for k, v in self.entries.iterator()}
        cache = ProximityCache(self.capacity, self.tolerance, self.policy)
        held = cache.bucket(np.zeros(0))
        order = (lambda n: stored[n][0]) if self.policy == "lru" else (lambda n: n)
        for n in sorted(stored, key=order):  # least recently used, or oldest, first
            held[n] = (np.array(stored[n][2]), stored[n][1])
        cache.made = made
        out, used = [], {}
        clock = max((e[0] for e in stored.values()), default=0)
        for at, i in due:
            value, v = self.waiting.getValue((at, i))
            self.waiting.removeKey((at, i))
            if self.idle_ms is not None and made and (at - last) // 1000 >= self.idle_ms:
                held.clear()
            q = np.array(v, float)
            found, clock, last = cache.find(q), clock + 1, at
            if found is None:
                cache.insert(q, value)
            made = cache.made
            if held and (found is None or self.policy == "lru"):
                used[next(reversed(held))] = clock  # what was just made or used stands last
            out.append((key[0], i, at, value, found is not None, value if found is None else found))
        for n in stored.keys() - held.keys():
            self.entries.removeKey((n,))
        for n, t in used.items():
            if n in held:
                self.entries.updateValue((n,), (t, held[n][1], held[n][0].tolist()))
        self.count.update((made, last))
        if self.idle_ms is not None:
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        return iter([pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANSWERS.split(", ")])])

    def close(self) -> None:
        pass


def cached_stream(rows: DataFrame, capacity: int, tolerance: float, policy: str, delay: str = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """ANSWERS of a stream (key, id, time, value, v); ``time`` a timestamp, ``delay`` how long rows may come late. Start it inside ``state_store``."""
    s = rows.withWatermark("time", delay).select("key", "id", F.unix_micros("time").alias("at"), "value", F.col("v").cast("array<double>").alias("v"), "time")
    return s.groupBy("key").transformWithStateInPandas(CacheProcessor(capacity, tolerance, policy, idle_ms), ANSWERS, "append", "eventTime")


def asked_events(spark, d: str) -> DataFrame:
    """Each event asks with the vector of its id; the event's user is the key."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    s = events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("at").alias("time"), F.get_json_object("props", "$.k").cast("long").alias("value"))
    return s.join(e, F.col("value") == F.col("vec_id")).drop("vec_id")


def q_stream_cache(spark, d):
    """With room for all and tolerance 0, a hit is a repeat."""
    with state_store(spark):
        out = drained(cached_stream(asked_events(spark, d), 1 << 20, 0.0, "fifo"), "append", "cache")
    return out.groupBy(F.col("key").alias("user_id")).agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"))


def q_stream_cache_lru(spark, d):
    """Sixteen entries a user, least recently used evicted first."""
    with state_store(spark):
        out = drained(cached_stream(asked_events(spark, d), 16, 0.0, "lru"), "append", "cache-lru")
    return out.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), F.col("value").alias("vec_id"), "hit")


QUERIES = {"stream_cache_state": q_stream_cache, "stream_cache_lru": q_stream_cache_lru}
ORACLE_SQL = {
    "stream_cache_state": "with k as (select user_id, (props::json ->> '$.k')::bigint as id, count(*) as n from events join embeddings on vec_id = (props::json ->> '$.k')::bigint group by all), v as (select user_id, n, embedding::varchar as v from k join embeddings on vec_id = id) select user_id, sum(n)::bigint as queries, (sum(n) - count(distinct v))::bigint as hits from v group by user_id",
    "stream_cache_lru": """with q as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as seq, vec_id, embedding::varchar as v from events join embeddings on vec_id = (props::json ->> '$.k')::bigint),
l as (select *, lag(seq) over (partition by user_id, v order by seq) as last from q)
select event_id, user_id, vec_id, last is not null and (select count(distinct b.v) from q b where b.user_id = l.user_id and b.seq > l.last and b.seq < l.seq) < 16 as hit from l""",
}
