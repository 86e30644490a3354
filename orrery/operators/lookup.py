"""Passage lookup and dataset algebra: what a document store and a list of items would do, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.tables import table


def get_many(requests: DataFrame, store: DataFrame, ids: str = "ids", key: str = "pid", value: str = "title", missing: bool = True) -> DataFrame:
    """Values for each request's id list, in its order; ``missing``: null for an unknown id, else it is left out. Repeats share."""
    flat = requests.select("req", F.posexplode_outer(ids).alias("pos", key))
    joined = flat.join(store.select(key, F.col(value).alias("_value"), F.lit(True).alias("_known")), key, "left")
    if not missing:
        joined = joined.where("_known")
    return joined.groupBy("req").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("_value").alias("v")))), lambda x: x.v).alias("values"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one written last. A max_by aggregate, so that a hot key is reduced before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_last")).select(key, "_last.*")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds idx, 0-based in ``order``, without one task for all rows: ranges, a row number and a count in each, and an offset.

    The ranges' bounds are literals, so that every branch of the plan deals alike; they come from the 100 rows a shuffle
    partition whose keys hash lowest, which moves work only. Rows that tie in ``order`` are numbered in any order.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*order)
    keys = rows.select(*order)
    lowest = keys.withColumn("_hash", F.xxhash64(*order)).orderBy("_hash", *order).limit(100 * n)
    sample = lowest.drop("_hash").orderBy(*order).collect()
    bounds = [sample[k * len(sample) // n] for k in range(1, n)] if sample else []
    literals = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, keys.schema, strict=True))) for b in dict.fromkeys(bounds)]
    part = F.size(F.array_remove(F.array(*(b <= key for b in literals)), False)) if literals else F.lit(0)
    dealt = rows.withColumn("_part", part)
    numbers = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off"))
    return numbers.join(F.broadcast(offsets), "_part").withColumn("idx", F.col("_in") + F.col("_off")).drop("_part", "_in", "_off")


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Adds batch: contiguous chunks of ``size`` by idx."""
    return rows.withColumn("batch", F.floor(F.col("idx") / size))


def merge_by_symbols(parts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Re-interleaves: the n-th row of a part goes to the n-th place of its symbol. parts: (symbol, pos, ..), symbols: (at, symbol)."""
    p = parts.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy("pos")))
    s = symbols.withColumn("nth", F.row_number().over(Window.partitionBy("symbol").orderBy("at")))
    return s.join(p, ["symbol", "nth"])


def store(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.substring_index("text", "\n", 1).alias("title"))


def requests(spark, d: str) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, d, "embeddings").select(n.alias("req"), F.array(n, n * 7 + 3, n, F.lit(-1).cast("long")).alias("ids"))


def q_docstore_get_many(spark, d):
    return get_many(requests(spark, d), store(spark, d)).select("req", F.array_join("values", "|", "<none>").alias("titles"), F.size("values").alias("n"))


def q_docstore_inner(spark, d):
    return get_many(requests(spark, d), store(spark, d), missing=False).select("req", F.array_join("values", "|").alias("titles"), F.size("values").alias("n"))


def q_dedup_keep_last(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return keep_last(e, "user_id", "event_id").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))


def q_filter_by_ids(spark, d):
    wanted = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").join(wanted, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def q_merge_split(spark, d):
    """Items split by language and merged again by the sequence of symbols: every document is back in its place."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    parts = docs.select(F.col("lang").alias("symbol"), F.col("doc_id").alias("pos"))
    m = merge_by_symbols(parts, docs.select(F.col("doc_id").alias("at"), F.col("lang").alias("symbol")))
    return m.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("at") == F.col("pos")).alias("in_place"))


def q_batches(spark, d):
    o = numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return batches(o, 1000).groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


def q_running_offset(spark, d):
    """Byte offset of each conversation turn, were a conversation written as lines."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).cast("long").alias("offset"))


def profile(rows: DataFrame) -> DataFrame:
    """(key, present, share, blank, min_len, avg_len, max_len) of every column as text: one pass, one aggregate."""
    stacked = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("v")) for c in rows.columns))).alias("x")).select("x.*")
    n = F.length("v")
    return stacked.groupBy("key").agg(F.count("v").alias("present"), F.round(F.count("v") / F.count("*"), 6).alias("share"), F.count_if(F.trim("v") == "").alias("blank"), F.min(n).alias("min_len"), F.round(F.avg(n), 4).alias("avg_len"), F.max(n).alias("max_len"))


def q_json_profile(spark, d):
    return profile(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def q_event_props(spark, d):
    """JSON in a string column, read by an explicit schema."""
    p = F.from_json("props", "k INT, missing STRING")
    return table(spark, d, "events").select("event_type", p.alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("k_sum"), F.count("p.k").alias("k_read"), F.count("p.missing").alias("missing"))


def first_gold(golds: Column) -> Column:
    return F.get(F.filter(golds, lambda g: F.trim(g) != ""), F.lit(0))


def q_gold_normalizer(spark, d):
    g = F.array(F.lit(" "), F.get(F.split("text", "\n"), F.lit(1)), F.get(F.split("text", "\n"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.md5(first_gold(F.filter(g, lambda x: x.isNotNull()))).alias("gold_md5"))


def q_result_normalizer(spark, d):
    """First non-empty of several fields, rank from one, defaults."""
    c = table(spark, d, "conversations")
    text = F.coalesce(F.nullif(F.when(F.col("role") == "tool", F.col("text")), F.lit("")), F.nullif(F.trim("text"), F.lit("")), F.lit("(empty)"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", text.alias("t")))), lambda x: F.md5(x.t)).alias("x")).select("conv_id", F.posexplode("x").alias("p", "text_md5")).select("conv_id", (F.col("p") + 1).alias("rank"), "text_md5")


def q_experiment_grid(spark, d):
    """Cross product of two sweep lists, and a zip that repeats the last of the shorter; a run id from the sorted settings."""
    a = spark.createDataFrame([(i, x) for i, x in enumerate((1, 5, 10))], "i int, k int")
    b = spark.createDataFrame([(i, x) for i, x in enumerate((0.0, 0.5))], "i int, t double")
    grid = a.select("k").join(F.broadcast(b.select("t")), F.lit(True)).select(F.lit("cross").alias("mode"), "k", "t")
    zipped = a.join(b, a.i == b.i, "left").select(F.lit("zip").alias("mode"), "k", F.coalesce("t", F.lit(0.5)).alias("t"))
    return grid.union(zipped).withColumn("run_id", F.substring(F.md5(F.to_json(F.struct("k", "t"))), 1, 10))


QUERIES = {
    "docstore_get_many": q_docstore_get_many, "docstore_inner": q_docstore_inner, "dedup_keep_last": q_dedup_keep_last, "filter_by_ids": q_filter_by_ids, "merge_split": q_merge_split,
    "batches": q_batches, "running_offset": q_running_offset, "json_profile": q_json_profile, "event_props": q_event_props, "gold_normalizer": q_gold_normalizer,
    "result_normalizer": q_result_normalizer, "experiment_grid": q_experiment_grid,
}
_REQ = "with f as (select vec_id as req, unnest([vec_id, vec_id * 7 + 3, vec_id, -1]) as pid, unnest([0, 1, 2, 3]) as pos from embeddings), s as (select doc_id as pid, split_part(text, chr(10), 1) as title from documents)"
ORACLE_SQL = {
    "docstore_get_many": _REQ + " select req, string_agg(coalesce(title, '<none>'), '|' order by pos) as titles, count(*)::int as n from f left join s using (pid) group by req",
    "docstore_inner": _REQ + " select req, string_agg(title, '|' order by pos) as titles, count(*)::int as n from f join s using (pid) group by req",
    "dedup_keep_last": "select user_id, event_id, event_type, round(value, 4) as value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "filter_by_ids": "select lang, count(*) as n, sum(doc_id)::bigint as ids from documents where doc_id in (select doc_id from labels where quality = 1) group by lang",
    "merge_split": "select lang as symbol, count(*) as n, count(*) as in_place from documents group by lang",
    "batches": "with n as (select *, row_number() over (order by o_orderkey) - 1 as idx from orders) select idx // 1000 as batch, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last, round(sum(o_totalprice), 2) as amount from n group by 1",
    "running_offset": "select conv_id, turn, coalesce(sum(strlen(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from conversations",
    "json_profile": "with s as (select unnest(['doc_id', 'text', 'lang', 'source']) as key, unnest([doc_id::varchar, text, lang, source]) as v from documents) select key, count(v) as present, round(count(v) / count(*)::double, 6) as share, count(*) filter (trim(v) = '') as blank, min(length(v))::int as min_len, round(avg(length(v)), 4) as avg_len, max(length(v))::int as max_len from s group by key",
    "event_props": "select event_type, sum((props::json ->> '$.k')::int)::bigint as k_sum, count(props::json ->> '$.k') as k_read, count(props::json ->> '$.missing') as missing from events group by 1",
    "gold_normalizer": "select doc_id, md5(list_filter([' ', string_split(text, chr(10))[2], string_split(text, chr(10))[1]], lambda g: g is not null and trim(g) <> '')[1]) as gold_md5 from documents",
    "result_normalizer": "select conv_id, row_number() over (partition by conv_id order by turn, t)::int as rank, md5(t) as text_md5 from (select conv_id, turn, coalesce(nullif(case when role = 'tool' then text end, ''), nullif(trim(text), ''), '(empty)') as t from conversations)",
    "experiment_grid": """with g as (select 'cross' as mode, k::int as k, t::double as t from (select unnest([1, 5, 10]) as k) cross join (select unnest([0.0, 0.5]) as t) union all select 'zip', unnest([1, 5, 10])::int, unnest([0.0, 0.5, 0.5])::double)
select mode, k, t, left(md5('{"k":' || k || ',"t":' || t || '}'), 10) as run_id from g""",
}
