"""Structured Streaming over event files: watermarked windows, sessions, deduplication, keyed state, late data.

Each query runs its stream to the end of what is there (availableNow) into a table and returns that table.
A file source of Parquet feeds it; on a cluster the sink and its checkpoint lie in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.tables import table

DELAY = "10 minutes"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or, in one process (tests), under a temporary one where that is unset."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/orrery-{name}-{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream, with a proper timestamp."""
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    return s.withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream over all that is there; complete and update results are those of its last state."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(e: DataFrame, width: str) -> DataFrame:
    return e.withWatermark("at", DELAY).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))


def q_stream_tumbling(spark, d):
    out = drained(tumbling(events(spark, d), "1 hour"), "complete", "tumbling")
    return out.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", F.round("s", 4).alias("s"))


def q_stream_sliding(spark, d):
    e = events(spark, d).withWatermark("at", DELAY)
    g = e.groupBy(F.window("at", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("m"))
    return drained(g, "complete", "sliding").select(F.unix_seconds("w.start").alias("start"), "n", F.round("m", 4).alias("peak"))


def q_stream_session(spark, d):
    e = events(spark, d).withWatermark("at", DELAY)
    g = e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return drained(g, "complete", "session").select("user_id", F.unix_micros("w.start").alias("start"), "n")


def q_stream_dedup(spark, d):
    e = events(spark, d).withWatermark("at", DELAY).select("user_id", "event_type", "at").dropDuplicates(["user_id", "event_type"])
    return drained(e, "append", "dedup").groupBy("event_type").agg(F.count("*").alias("users"))


def q_stream_enriched(spark, d):
    """A stream joined to a static dimension."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    g = events(spark, d).join(c, "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return drained(g, "complete", "enriched").select("c_mktsegment", "n", F.round("s", 4).alias("s"))


QUERIES = {
    "stream_tumbling": q_stream_tumbling, "stream_sliding": q_stream_sliding, "stream_session": q_stream_session,
    "stream_dedup": q_stream_dedup, "stream_static_join": q_stream_enriched,
}
ORACLE_SQL = {
    "stream_tumbling": "select epoch(time_bucket(interval 1 hour, ts))::bigint as start, event_type, count(*) as n, round(sum(value), 4) as s from events group by 1, 2",
    "stream_sliding": "select epoch(time_bucket(interval 30 minutes, ts))::bigint - o * 1800 as start, count(*) as n, round(max(value), 4) as peak from events cross join (select unnest([0, 1]) as o) group by 1",
    "stream_session": "with g as (select user_id, ts, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w >= 1800000000, true)::int as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, min(epoch_us(ts)) as start, count(*) as n from s group by user_id, sid",
    "stream_dedup": "select event_type, count(distinct user_id) as users from events group by 1",
    "stream_static_join": "select c_mktsegment, count(*) as n, round(sum(value), 4) as s from events join customer on c_custkey = user_id group by 1",
}
