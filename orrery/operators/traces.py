"""Service traces and telemetry over ``events``: a row is a request; errors are rows of type error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.tables import table

WARM_UP = 1
#: Stages that come first in a summary.
PREFERRED = ("click", "view", "retrieve", "purchase", "signup")


def traces(spark, d: str) -> DataFrame:
    """One row an event: run (user), ok, start and end (µs), stage, latency, retrieved id."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("stage"), (F.col("event_type") != "error").alias("ok"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), F.col("value").alias("latency"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def q_trace_summary(spark, d):
    """Per run without its first request: counts, error share, latency percentiles (nearest rank), throughput over the wall time."""
    w = Window.partitionBy("run").orderBy("start", "event_id")
    t = traces(spark, d).withColumn("r", F.row_number().over(w)).where(F.col("r") > WARM_UP)
    ok = F.when(F.col("ok"), F.col("latency"))
    wall = (F.max("start") - F.min("start")) / 1_000_000
    return t.groupBy("run").agg(
        F.count("*").alias("requests"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        *(F.round(F.expr(f"percentile_disc({q / 100}) within group (order by if(ok, latency, null))"), 6).alias(f"p{q}") for q in (50, 95, 99)),
        F.round(F.avg(ok), 6).alias("mean"), F.round(F.try_divide(F.count_if("ok"), wall), 9).alias("per_second"),
    )


def q_stage_means(spark, d):
    """A map of stage timings for each run, exploded and rolled up by stage: means with runs as the unit."""
    m = traces(spark, d).groupBy("run", "stage").agg(F.sum("latency").alias("t"))
    per = m.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("stage", "t"))).alias("timings"))
    return per.select("run", F.explode("timings").alias("stage", "t")).groupBy("stage").agg(F.round(F.avg("t"), 6).alias("mean"), F.count("*").alias("runs"))


def stage_columns(t: DataFrame, preferred: tuple[str, ...]) -> DataFrame:
    """(run, a column a stage) of sums: the preferred stages that occur, in their order, then the others by name."""
    seen = {r[0] for r in t.select("stage").where("stage is not null").distinct().collect()}  # names of stages, one a column
    order = [s for s in preferred if s in seen] + sorted(seen - set(preferred))
    p = t.groupBy("run").pivot("stage", order).agg(F.round(F.sum("latency"), 4))
    return p.select("run", *(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in order))


def q_summary_pivot(spark, d):
    return stage_columns(traces(spark, d), PREFERRED)


def q_dup_ratio_windows(spark, d):
    """Share of requests whose id was seen in the w seconds before; only the nearest earlier sighting can decide."""
    w = Window.partitionBy("k").orderBy("start", "event_id")
    t = traces(spark, d).where("ok").select("k", ((F.col("start") - F.lag("start").over(w)) / 1_000_000).alias("gap"))
    return t.agg(*(F.round(F.avg(F.coalesce((F.col("gap") <= s).cast("int"), F.lit(0))), 6).alias(f"within_{s}") for s in (60, 600, 3600)))


def q_loadgen_summary(spark, d):
    t = traces(spark, d).withColumn("end", F.col("start") + (F.col("latency") * 1_000_000).cast("long"))
    wall = (F.max(F.when(F.col("ok"), F.col("end"))) - F.min(F.when(F.col("ok"), F.col("start")))) / 1_000_000
    return t.agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("success"), F.round(F.count_if("ok") / wall, 9).alias("rps"), *(F.round(F.percentile(F.when(F.col("ok"), F.col("latency")), q / 100), 6).alias(f"p{q}") for q in (50, 95, 99)))


def q_resource_peaks(spark, d):
    """Peaks and means of a gauge by day."""
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.max("value"), 6).alias("peak"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))


def q_decode_rate(spark, d):
    """Ratio of sums with a floor, and rates that are null where they cannot be."""
    t = traces(spark, d)
    return t.groupBy("stage").agg(F.round(F.sum("k") / F.greatest(F.sum("latency"), F.lit(1e-9)), 6).alias("per_second"), F.round(F.sum(F.try_divide(F.col("k"), F.nullif(F.col("latency"), F.lit(0.0)))), 2).alias("sum_rates"))


def q_exact_string_cache(spark, d):
    """A cache by exact key: the first sight of a key is a miss, later ones are hits."""
    w = Window.partitionBy("stage", "k").orderBy("start", "event_id")
    t = traces(spark, d).withColumn("hit", F.row_number().over(w) > 1)
    return t.groupBy("stage").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


def q_batch_attribution(spark, d):
    """A batch's time spread over its items."""
    t = traces(spark, d).withColumn("batch", F.expr("event_id div 16"))
    w = Window.partitionBy("batch")
    return t.select("event_id", F.round(F.sum("latency").over(w) / F.count("*").over(w), 6).alias("share"))


def q_telemetry_join(spark, d):
    """Run summaries beside the peak of the same day's telemetry."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    peak = e.groupBy("day").agg(F.max("value").alias("peak"))
    runs = e.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    return runs.join(peak, "day").groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.avg("peak"), 6).alias("mean_peak"))


QUERIES = {
    "trace_summary": q_trace_summary, "stage_means": q_stage_means, "summary_pivot": q_summary_pivot, "dup_ratio_windows": q_dup_ratio_windows, "loadgen_summary": q_loadgen_summary,
    "resource_peaks": q_resource_peaks, "decode_rate": q_decode_rate, "exact_string_cache": q_exact_string_cache, "batch_attribution": q_batch_attribution, "telemetry_join": q_telemetry_join,
}
_T = "with t as (select user_id as run, event_id, event_type as stage, event_type <> 'error' as ok, epoch_us(ts) as start, value as latency, (props::json ->> '$.k')::int as k from events)"
ORACLE_SQL = {
    "trace_summary": _T + ", r as (select *, row_number() over (partition by run order by start, event_id) as r from t) select run, count(*) as requests, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed, " + ", ".join(f"round(quantile_disc(latency, {q / 100}) filter (ok), 6) as p{q}" for q in (50, 95, 99)) + ", round(avg(latency) filter (ok), 6) as mean, round(count(*) filter (ok) / nullif((max(start) - min(start)) / 1000000.0::double, 0), 9) as per_second from r where r > 1 group by run",
    "stage_means": _T + ", m as (select run, stage, sum(latency) as t from t group by all) select stage, round(avg(t), 6) as mean, count(*) as runs from m group by stage",
    "summary_pivot": _T + " select run, " + ", ".join(f"round(coalesce(sum(latency) filter (stage = '{s}'), 0), 4) as {s}" for s in ("click", "view", "purchase", "signup", "error")) + " from t group by run",
    "dup_ratio_windows": _T + ", g as (select (start - lag(start) over (partition by k order by start, event_id)) / 1000000.0::double as gap from t where ok) select " + ", ".join(f"round(avg(coalesce((gap <= {s})::int, 0)), 6) as within_{s}" for s in (60, 600, 3600)) + " from g",
    "loadgen_summary": _T + " select round(avg(ok::int), 6) as success, round(count(*) filter (ok) / ((max(start + trunc(latency * 1000000)::bigint) filter (ok) - min(start) filter (ok)) / 1000000.0::double), 9) as rps, " + ", ".join(f"round(quantile_cont(latency, {q / 100}) filter (ok), 6) as p{q}" for q in (50, 95, 99)) + " from t",
    "resource_peaks": "select ts::date::varchar as day, round(max(value), 6) as peak, round(avg(value), 6) as mean, count(*) filter (event_type = 'error') as errors from events group by 1",
    "decode_rate": _T + " select stage, round(sum(k) / greatest(sum(latency), 1e-9), 6) as per_second, round(sum(k / nullif(latency, 0)), 2) as sum_rates from t group by stage",
    "exact_string_cache": _T + ", h as (select stage, row_number() over (partition by stage, k order by start, event_id) > 1 as hit from t) select stage, count(*) filter (hit) as hits, count(*) filter (not hit) as misses, round(avg(hit::int), 6) as hit_rate from h group by stage",
    "batch_attribution": "select event_id, round(sum(value) over w / count(*) over w, 6) as share from events window w as (partition by event_id // 16)",
    "telemetry_join": "with e as (select *, ts::date as day from events), p as (select day, max(value) as peak from e group by day), r as (select user_id, day, count(*) as n from e group by all) select user_id, sum(n)::bigint as n, round(avg(peak), 6) as mean_peak from r join p using (day) group by user_id",
}
