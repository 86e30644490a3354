"""Item-level pieces: id maps, slices of one ranking, question flags, list parsing, task templates, truncation, result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.vectors import COSINE, neighbours
from orrery.sources.tables import table

#: Task instructions; every one names the question.
TEMPLATES = {
    "short": "Answer in a few words. Question: {question}",
    "choice": "Choose one option and give its letter. Question: {question}",
    "verify": "Say whether the claim is supported. Claim: {question}",
}


def remapped(hits: DataFrame, id_map: DataFrame) -> DataFrame:
    """Hit rows with ids through (row, id): negative rows are no hits, rows without an id go."""
    return hits.where(F.col("doc_id") >= 0).join(id_map, F.col("doc_id") == F.col("row")).drop("doc_id", "row").withColumnRenamed("id", "doc_id")


def q_id_remap(spark, d):
    n = neighbours(spark, d, 5, "cosine").withColumn("doc_id", F.when(F.col("rank") == 5, F.lit(-1).cast("long")).otherwise(F.col("doc_id")))
    ids = table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("row"), (F.col("doc_id") * 10).alias("id"))
    return remapped(n, ids).select("qid", "rank", "doc_id")


def q_k_slices(spark, d):
    """One ranking, read at several k."""
    ks = spark.createDataFrame([(1,), (3,), (5,), (10,)], "k int")
    n = neighbours(spark, d, 10, "cosine").join(F.broadcast(ks), F.col("rank") <= F.col("k"))
    return n.groupBy("k").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("ids"), F.round(F.avg("score"), 5).alias("mean"))


def question_flags(q: Column) -> dict[str, Column]:
    """Overlapping kinds by the words that occur."""
    low = F.lower(q)
    return {"is_who": F.contains(low, F.lit("who")), "is_when": F.contains(low, F.lit("when")) | F.contains(low, F.lit("year")), "is_where": F.contains(low, F.lit("where")), "is_many": F.contains(low, F.lit("how many"))}


def q_question_flags(spark, d):
    f = question_flags(F.col("text"))
    return table(spark, d, "documents").agg(*(F.count_if(c).alias(n) for n, c in f.items()))


def parsed_numbers(x: Column) -> Column:
    """Numbers of a list in text, separated by commas, semicolons or spaces; ``none`` is a null; repeats go, order stays."""
    parts = F.filter(F.split(F.lower(x), r"[,;\s]+"), lambda s: s != "")
    return F.array_distinct(F.transform(parts, lambda s: F.when(s == "none", F.lit(None)).otherwise(s.try_cast("double"))))


def q_parse_lists(spark, d):
    x = F.concat_ws(", ", F.lit("none"), (F.col("event_id") % 5).cast("string"), F.lit("3;1.5"), F.col("event_type"))
    n = parsed_numbers(x)
    return table(spark, d, "events").select("event_id", F.size(n).alias("n"), F.round(F.aggregate(F.filter(n, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v), 3).alias("sum"))


def instructed(question: Column, task: Column) -> Column:
    """The task's template with the question in its place; an unknown task is an error."""
    out = F.raise_error(F.concat(F.lit("unknown task "), task)).cast("string")
    for name, t in TEMPLATES.items():
        if "{question}" not in t:
            raise ValueError(f"template {name} has no place for the question")
        head, tail = t.split("{question}")
        out = F.when(task == name, F.concat(F.lit(head), question, F.lit(tail))).otherwise(out)
    return out


def q_task_templates(spark, d):
    b = table(spark, d, "benchmark")
    tasks = F.explode(F.array(*map(F.lit, TEMPLATES))).alias("task")
    return b.select("item_id", "text", tasks).select("item_id", "task", F.md5(instructed(F.col("text"), F.col("task"))).alias("prompt_md5"))


def halves(words: Column, most: int) -> Column:
    """The first and last half of ``most`` words of a longer list."""
    h = most // 2
    return F.when(F.size(words) <= most, words).otherwise(F.concat(F.slice(words, 1, h), F.slice(words, F.size(words) - (most - h) + 1, F.lit(most - h))))


def q_word_truncation(spark, d):
    w = halves(F.split("text", " "), 64)
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.md5(F.array_join(w, " ")).alias("kept_md5"))


def q_result_rows(spark, d):
    """Lists as JSON, flags as 0 and 1, ten entries at most: the flat row of a result."""
    n = neighbours(spark, d, 12, "cosine").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id).alias("ids"), (F.max("score") >= 0.5).alias("close"))
    return n.select("qid", F.to_json(F.slice("ids", 1, 10)).alias("ids"), F.col("close").cast("int").alias("close"))


def q_synthetic_queries(spark, d):
    n = table(spark, d, "embeddings").agg(F.count("*").alias("n"))
    return n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("i", F.concat(F.lit("example query "), F.col("i").cast("string")).alias("query"))


def q_trace_flatten(spark, d):
    """A nested trace as columns, its timings map as rows again."""
    e = table(spark, d, "events").select(F.struct(F.col("event_id").alias("id"), F.create_map(F.lit("total"), "value", F.lit("half"), F.col("value") / 2).alias("timings_s"), (F.col("event_type") == "view").alias("cache_used")).alias("trace"))
    return e.select("trace.id", "trace.cache_used", F.explode("trace.timings_s").alias("stage", "t")).groupBy("stage", "cache_used").agg(F.count("*").alias("n"), F.round(F.sum("t"), 4).alias("t"))


def q_rank_by_score(spark, d):
    """Stable sort by score, position breaking ties, ten best of each user's events."""
    w = Window.partitionBy("user_id").orderBy(F.desc(F.floor("value")), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank")).where("rank <= 10")


QUERIES = {
    "id_remap": q_id_remap, "k_slices": q_k_slices, "question_flags": q_question_flags, "parse_lists": q_parse_lists, "task_templates": q_task_templates, "word_truncation": q_word_truncation,
    "result_rows": q_result_rows, "synthetic_queries": q_synthetic_queries, "trace_flatten": q_trace_flatten, "rank_by_score": q_rank_by_score,
}
ORACLE_SQL = {
    "id_remap": COSINE + " select qid, rank, doc_id * 10 as doc_id from r join documents using (doc_id) where rank <= 4 and doc_id % 3 <> 0",
    "k_slices": COSINE + " select k::int as k, count(*) as hits, count(distinct doc_id) as ids, round(avg(round(s, 6)), 5) as mean from r join (select unnest([1, 3, 5, 10]) as k) on rank <= k group by k",
    "question_flags": "select count(*) filter (contains(lower(text), 'who')) as is_who, count(*) filter (contains(lower(text), 'when') or contains(lower(text), 'year')) as is_when, count(*) filter (contains(lower(text), 'where')) as is_where, count(*) filter (contains(lower(text), 'how many')) as is_many from documents",
    "parse_lists": "select event_id, (3 + (event_id % 5 <> 3)::int)::int as n, round(4.5::double + case when event_id % 5 <> 3 then event_id % 5 else 0 end, 3) as sum from events",
    "task_templates": "select item_id, t.task, md5(t.head || text) as prompt_md5 from benchmark cross join (select unnest(['short', 'choice', 'verify']) as task, unnest(['Answer in a few words. Question: ', 'Choose one option and give its letter. Question: ', 'Say whether the claim is supported. Claim: ']) as head) t",
    "word_truncation": "with w as (select doc_id, string_split(text, ' ') as w from documents), h as (select doc_id, case when len(w) <= 64 then w else w[1:32] || w[len(w) - 31:len(w)] end as h from w) select doc_id, len(h)::int as n, md5(array_to_string(h, ' ')) as kept_md5 from h",
    "result_rows": COSINE + " select qid, '[' || string_agg(doc_id, ',' order by rank) filter (rank <= 10) || ']' as ids, (max(round(s, 6)) >= 0.5)::int as close from r where rank <= 12 group by qid",
    "synthetic_queries": "select i, 'example query ' || i as query from (select unnest(range(count(*))) as i from embeddings)",
    "trace_flatten": "select stage, event_type = 'view' as cache_used, count(*) as n, round(sum(case stage when 'total' then value else value / 2 end), 4) as t from events cross join (select unnest(['total', 'half']) as stage) group by 1, 2",
    "rank_by_score": "select user_id, event_id, row_number() over (partition by user_id order by floor(value) desc, event_id)::int as rank from events qualify rank <= 10",
}
