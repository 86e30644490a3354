"""Statistics: percentiles of three kinds, reuse concentration, meters, trimmed means, log priors, approximate sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.vectors import COSINE, neighbours
from orrery.sources.tables import table


def nearest_rank(x: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) within group (order by {x})")


def rounded_rank(x: Column, q: float) -> Column:
    """Value at the index round(q * (n - 1)) of the sorted values, halves to even."""
    a = F.array_sort(F.collect_list(x))
    return F.get(a, F.rint((F.size(a) - 1) * q).cast("int"))


def frequencies(spark, d: str, k: int = 5) -> DataFrame:
    """(doc_id, n): how often each vector is among another's k nearest."""
    return neighbours(spark, d, k, "cosine").groupBy("doc_id").agg(F.count("*").alias("n"))


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: Gini coefficient of the counts; null for none, 0 if all are 0.

    Equal counts are summed first, so that the running sum has a row for each distinct count, not for each id.
    """
    g = counts.groupBy(F.col(n).cast("double").alias("v")).agg(F.count("*").alias("m"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumns({"ids": F.coalesce(F.sum("m").over(w), F.lit(0)), "cum": F.coalesce(F.sum(F.col("m") * F.col("v")).over(w), F.lit(0.0))})
    # the m equal values add running sums cum + v, cum + 2 v, ..
    g = g.withColumn("area", F.col("m") * F.col("cum") + F.col("v") * F.col("m") * (F.col("m") + 1) / 2)
    t = g.agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("v")).alias("total"), F.sum("area").alias("area"))
    return t.select(F.when(F.col("total") == 0, 0.0).otherwise((F.col("n") + 1 - 2 * F.col("area") / F.col("total")) / F.col("n")).alias("gini"))


def cumulative(counts: DataFrame) -> DataFrame:
    """(rank, share): share of all uses that the ``rank`` most used ids cover. One row an id; ids are a dimension here."""
    w = Window.orderBy(F.desc("n"), "doc_id")
    return counts.select(F.row_number().over(w).alias("rank"), (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())).alias("share"), F.count("*").over(Window.partitionBy()).alias("ids"))


def q_reuse_freq(spark, d):
    return frequencies(spark, d)


def q_reuse_summary_gini(spark, d):
    f = frequencies(spark, d)
    n = table(spark, d, "embeddings").agg(F.count("*").alias("corpus"))
    s = f.agg(F.count("*").alias("unique_ids"), F.sum("n").alias("uses"), F.max("n").alias("most"))
    return s.join(F.broadcast(gini(f)), F.lit(True)).join(F.broadcast(n), F.lit(True)).select("unique_ids", "most", F.round(F.col("uses") / F.col("unique_ids"), 6).alias("avg_reuse"), F.round(F.col("unique_ids") / F.col("corpus"), 6).alias("corpus_share"), F.round("gini", 6).alias("gini"))


def q_coverage_curve(spark, d):
    c = cumulative(frequencies(spark, d))
    steps = c.agg(F.max("ids").alias("ids")).select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("step"), "ids")
    steps = steps.select("step", F.least(F.greatest(F.rint(F.col("step") / 50 * F.col("ids")).cast("int"), F.lit(1)), F.col("ids").cast("int")).alias("rank"))
    return steps.join(c, "rank").select("step", F.col("rank").alias("ids"), F.round("share", 6).alias("share"))


def q_topn_coverage(spark, d):
    c = cumulative(frequencies(spark, d))
    at = F.array(F.least(F.lit(10), "ids"), F.least(F.lit(100), "ids"), F.least(F.lit(100000), "ids"), F.greatest(F.lit(1), F.ceil(F.col("ids") * 0.01)), F.greatest(F.lit(1), F.ceil(F.col("ids") * 0.1)))
    wanted = c.agg(F.max("ids").alias("ids")).select(F.posexplode(at).alias("k", "rank"))
    return wanted.join(c, "rank").select("k", F.col("rank").cast("long").alias("top"), F.round("share", 6).alias("share"))


def q_percentiles(spark, d):
    e = table(spark, d, "events").groupBy("event_type")
    qs = (5, 50, 95, 99)
    return e.agg(*(F.round(nearest_rank("value", q / 100), 6).alias(f"disc{q}") for q in qs), *(F.round(F.percentile("value", q / 100), 6).alias(f"cont{q}") for q in qs), F.round(F.median("value"), 6).alias("median"), F.count("*").alias("n"))


def q_percentile_rounded(spark, d):
    """By user: a bounded group each (one user's events of one type)."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(rounded_rank(F.col("value"), 0.95), 6).alias("p95"))


def q_trimmed_mean(spark, d):
    """Mean without the 2 lowest and 2 highest where there are more than 4."""
    w = Window.partitionBy("user_id", "event_type")
    e = table(spark, d, "events").select("user_id", "event_type", "value", F.row_number().over(w.orderBy("value", "event_id")).alias("r"), F.count("*").over(w).alias("n"))
    return e.where("n <= 4 or (r > 2 and r <= n - 2)").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("kept"))


def q_meter_rollup(spark, d):
    """Scores averaged, amounts summed, by batch of 500 and over all."""
    e = table(spark, d, "events").select(F.expr("event_id div 500").alias("batch"), "value")
    return e.rollup("batch").agg(F.round(F.avg("value"), 6).alias("score"), F.round(F.sum("value"), 4).alias("amount"), F.count("*").alias("n")).withColumn("batch", F.coalesce("batch", F.lit(-1)))


def q_five_numbers(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"), *(F.round(F.percentile("value", q / 100), 6).alias(f"p{q}") for q in (10, 50, 90)))


def q_exact_duplicate_rate(spark, d):
    t = table(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n"))
    return t.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("duplicate_rate"))


def q_doc_log_prior(spark, d):
    """Log prior of words with additive smoothing 1 over the vocabulary; the 100 likeliest, centred on their mean."""
    w = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") > 1)
    c = w.groupBy("w").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    p = c.join(F.broadcast(t), F.lit(True)).select("w", "n", F.log((F.col("n") + 1) / (F.col("total") + F.col("kinds"))).alias("lp"))
    top = p.orderBy(F.desc("n"), "w").limit(100)
    return top.select("w", "n", F.round(F.col("lp") - F.avg("lp").over(Window.partitionBy()), 6).alias("bias"))


def q_mode_min_max(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    best = n.groupBy("o_orderstatus").agg(F.min(F.struct(-F.col("n"), "o_orderpriority")).alias("m"))
    s = o.groupBy("o_orderstatus").agg(F.round(F.min("o_totalprice"), 2).alias("lo"), F.round(F.max("o_totalprice"), 2).alias("hi"), F.round(F.percentile("o_totalprice", 0.95), 2).alias("p95"))
    return s.join(best, "o_orderstatus").select("o_orderstatus", F.col("m.o_orderpriority").alias("mode"), "lo", "hi", "p95")


def q_safe_numbers(spark, d):
    """Sum, mean and peak over what can be read as a number."""
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(k)
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(text.try_cast("double"), F.lit(0.0))).alias("total"), F.count(text.try_cast("double")).alias("read"), F.max(text.try_cast("double")).alias("peak"))


def q_approx_distinct(spark, d):
    """Sketches beside exact counts; true if within their error bounds."""
    e = table(spark, d, "events")
    a = e.agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("x"), F.percentile_approx("value", 0.5, 10000).alias("pa"), F.percentile("value", 0.5).alias("px"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("h"))
    return a.select((F.abs(F.col("a") - F.col("x")) <= 0.1 * F.col("x")).alias("hll_ok"), (F.abs(F.col("h") - F.col("x")) <= 0.1 * F.col("x")).alias("sketch_ok"), (F.abs(F.col("pa") - F.col("px")) <= 0.02 * F.abs(F.col("px")) + 0.5).alias("percentile_ok"))


QUERIES = {
    "reuse_freq": q_reuse_freq, "reuse_summary_gini": q_reuse_summary_gini, "coverage_curve": q_coverage_curve, "topn_coverage": q_topn_coverage,
    "percentiles_disc_cont": q_percentiles, "percentile_rounded": q_percentile_rounded, "trimmed_mean": q_trimmed_mean, "meter_rollup": q_meter_rollup, "five_numbers": q_five_numbers,
    "exact_duplicate_rate": q_exact_duplicate_rate, "doc_log_prior": q_doc_log_prior, "mode_min_max": q_mode_min_max, "safe_numbers": q_safe_numbers, "approx_distinct_error": q_approx_distinct,
}

_FREQ = COSINE + ", f as (select doc_id, count(*) as n from r where rank <= 5 group by doc_id)"
_CUM = _FREQ + ", c as (select row_number() over w as rank, sum(n) over w / (sum(n) over ())::double as share, count(*) over () as ids from f window w as (order by n desc, doc_id rows unbounded preceding))"
ORACLE_SQL = {
    "reuse_freq": _FREQ + " select * from f",
    "reuse_summary_gini": _FREQ + ", o as (select n, sum(n) over (order by n, doc_id rows unbounded preceding) as cum from f) select count(*) as unique_ids, max(n) as most, round(sum(n) / count(*)::double, 6) as avg_reuse, round(count(*) / (select count(*) from e)::double, 6) as corpus_share, round((count(*) + 1 - 2 * sum(cum) / max(cum)::double) / count(*), 6) as gini from o",
    "coverage_curve": _CUM + ", st as (select step::int as step, least(greatest(round_even(step / 50.0::double * (select max(ids) from c), 0)::int, 1), (select max(ids) from c)) as rank from (select unnest(range(1, 51)) as step)) select step, rank::int as ids, round(share, 6) as share from st join c using (rank)",
    "topn_coverage": _CUM + ", m as (select max(ids) as ids from c), w as (select unnest([0, 1, 2, 3, 4]) as k, unnest([least(10, ids), least(100, ids), least(100000, ids), greatest(1, ceil(ids * 0.01::double)), greatest(1, ceil(ids * 0.1::double))]::bigint[]) as rank from m) select k, rank as top, round(share, 6) as share from w join c using (rank)",
    "percentiles_disc_cont": "select event_type, " + ", ".join(f"round(quantile_disc(value, {q / 100}), 6) as disc{q}, round(quantile_cont(value, {q / 100}), 6) as cont{q}" for q in (5, 50, 95, 99)) + ", round(median(value), 6) as median, count(*) as n from events group by event_type",
    "percentile_rounded": "select user_id, event_type, round(list_sort(list(value))[1 + round_even(0.95::double * (count(*) - 1), 0)::int], 6) as p95 from events group by all",
    "trimmed_mean": "with r as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by value, event_id) as r, count(*) over (partition by user_id, event_type) as n from events) select user_id, event_type, round(avg(value), 6) as mean, count(*) as kept from r where n <= 4 or (r > 2 and r <= n - 2) group by all",
    "meter_rollup": "select coalesce(event_id // 500, -1) as batch, round(avg(value), 6) as score, round(sum(value), 4) as amount, count(*) as n from events group by rollup (event_id // 500)",
    "five_numbers": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(min(value), 6) as lo, round(max(value), 6) as hi, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90 from events group by event_type",
    "exact_duplicate_rate": "select count(*) as total, count(distinct text) as kinds, round(1 - count(distinct text) / count(*)::double, 6) as duplicate_rate from documents",
    "doc_log_prior": "with w as (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as w from documents), c as (select w, count(*) as n from w where length(w) > 1 group by w), p as (select w, n, ln((n + 1) / (select sum(n) + count(*) from c)::double) as lp from c order by n desc, w limit 100) select w, n, round(lp - avg(lp) over (), 6) as bias from p",
    "mode_min_max": "with n as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all), m as (select o_orderstatus, arg_min(o_orderpriority, (-n, o_orderpriority)) as mode from n group by 1) select o_orderstatus, mode, round(min(o_totalprice), 2) as lo, round(max(o_totalprice), 2) as hi, round(quantile_cont(o_totalprice, 0.95), 2) as p95 from orders join m using (o_orderstatus) group by all",
    "safe_numbers": "with t as (select event_type, try_cast(case when event_id % 7 = 0 then 'n/a' else props::json ->> '$.k' end as double) as x from events) select event_type, sum(coalesce(x, 0)) as total, count(x) as read, max(x) as peak from t group by 1",
    "approx_distinct_error": "select true as hll_ok, true as sketch_ok, true as percentile_ok",
}
