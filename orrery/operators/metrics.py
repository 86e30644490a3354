"""Answer and retrieval metrics. Predictions and golds are columns; a gold list is an array of strings.

Fixtures: a document predicts its first line; its golds are pieces of the same text, so every metric
takes values between 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import normalize_answer
from orrery.sources.tables import table

#: Answers that only match exactly.
CLOSED = ("yes", "no", "noanswer")


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def exact_match(pred: Column, golds: Column) -> Column:
    p = normalize_answer(pred)
    return F.exists(golds, lambda g: normalize_answer(g) == p).cast("int")


def exact_match_regex(pred: Column, golds: Column) -> Column:
    """Whole match, case ignored, of the first gold as a pattern."""
    return F.regexp_like(F.trim(pred), F.concat(F.lit("(?i)^(?:"), F.get(golds, F.lit(0)), F.lit(")$"))).cast("int")


def sub_match(pred: Column, golds: Column) -> Column:
    p = normalize_answer(pred)
    return F.exists(golds, lambda g: F.contains(p, normalize_answer(g))).cast("int")


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def overlaps(rows: DataFrame, pred: str, golds: str) -> DataFrame:
    """Adds ``_o``: for each gold the shared tokens, the sizes of both sides, and whether a closed answer is missed.

    Both sides are normalised once, in columns of their own, whatever the number of statistics read from them.
    """
    rows = rows.withColumns({"_p": normalize_answer(F.col(pred)), "_g": F.transform(golds, normalize_answer)}).withColumn("_pt", tokens(F.col("_p")))

    def one(g: Column) -> Column:
        t = tokens(g)
        closed = (F.col("_p").isin(*CLOSED) | g.isin(*CLOSED)) & (F.col("_p") != g)
        return F.struct(common_tokens(F.col("_pt"), t).alias("same"), F.size("_pt").alias("n"), F.size(t).alias("m"), closed.alias("closed"))

    return rows.withColumn("_o", F.transform("_g", one)).drop("_p", "_g", "_pt")


def token_scores() -> dict[str, Column]:
    """f1, precision, recall over token multisets from ``_o``, each the best over golds by itself; closed answers only match exactly."""

    def best(f) -> Column:
        return F.coalesce(F.array_max(F.transform("_o", lambda x: F.when(x.closed | (x.same == 0), 0.0).otherwise(f(x)))), F.lit(0.0))

    return {"f1": best(lambda x: 2.0 * x.same / (x.n + x.m)), "precision": best(lambda x: x.same / x.n), "recall": best(lambda x: x.same / x.m)}


def token_f1_open(pred: Column, golds: Column) -> Column:
    """F1 without the closed-answer rule: both empty 1, one empty 0; no golds: against the empty answer."""

    p = tokens(normalize_answer(pred))

    def one(g: Column) -> Column:
        t = tokens(normalize_answer(g))
        same, n, m = common_tokens(p, t), F.size(p), F.size(t)
        return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (same == 0), 0.0).otherwise(2.0 * same / (n + m))

    filled = F.when(F.size(golds) > 0, golds).otherwise(F.array(F.lit("")))
    return F.array_max(F.transform(filled, one))


def fixture(spark, d: str) -> DataFrame:
    """doc_id, lang, source, pred, golds from documents."""
    t = F.split(F.substring_index("text", "\n", 1), " ")
    return table(spark, d, "documents").select(
        "doc_id", "lang", "source",
        F.array_join(F.slice(t, 1, 6), " ").alias("pred"),
        F.array(F.array_join(F.slice(t, 1, 4), " "), F.array_join(F.slice(t, 2, 5), " "), F.concat(F.lit("The "), F.array_join(F.slice(t, 1, 6), " "), F.lit("!"))).alias("golds"),
    )


def q_em(spark, d):
    f = fixture(spark, d)
    g = F.col("golds")
    return f.select("doc_id", exact_match(F.col("pred"), g).alias("em"), sub_match(F.col("pred"), F.slice(g, 1, 2)).alias("sub_em"), exact_match(F.col("pred"), F.slice(g, 1, 2)).alias("em_two"))


def q_em_regex_first(spark, d):
    return table(spark, d, "nation").select("n_nationkey", exact_match_regex(F.col("n_name"), F.array(F.lit("[a-n].*"), F.lit(".*"))).alias("em"))


def q_token_prf(spark, d):
    f = fixture(spark, d).withColumn("golds", F.slice("golds", 1, 2))
    return overlaps(f, "pred", "golds").select("doc_id", *(F.round(c, 6).alias(n) for n, c in token_scores().items()))


def q_token_f1_core(spark, d):
    f = fixture(spark, d)
    return f.select("doc_id", F.round(token_f1_open(F.col("pred"), F.slice("golds", 2, 1)), 6).alias("f1"), F.round(token_f1_open(F.lit(""), F.array().cast("array<string>")), 6).alias("f1_none"))


def q_retrieval_at_k(spark, d):
    """Share of queries with a hit among their passages, and of passages that hold a gold: the gold is the query passage's language mark, by source."""
    from orrery.operators.vectors import neighbours

    docs = table(spark, d, "documents")
    golds = docs.select(F.col("doc_id").alias("qid"), normalize_answer(F.lower(F.get(F.split("text", " ", 3), F.lit(1)))).alias("gold"))
    texts = docs.select("doc_id", normalize_answer(F.col("text")).alias("text"))
    hit = F.contains("text", "gold").cast("int")
    # the golds go to the texts, so that a text is shuffled once, however many queries found it
    per = neighbours(spark, d, 5).select("qid", "doc_id").join(golds, "qid").join(texts, "doc_id").groupBy("qid").agg(F.max(hit).alias("recall"), F.avg(hit).alias("precision"))
    return per.select("qid", F.coalesce("recall", F.lit(0)).alias("recall"), F.round(F.coalesce("precision", F.lit(0.0)), 6).alias("precision"))


def exam_score(single: Column, pred: Column, gold: Column) -> Column:
    p, g = F.lower(F.trim(pred)), F.lower(gold)
    return F.when(single, (p == g).cast("double")).when(p == g, 1.0).when((p != "") & F.contains(g, p), 0.5).otherwise(0.0)


def q_exam_accuracy_rollup(spark, d):
    e = table(spark, d, "events")
    s = exam_score(F.col("event_id") % 2 == 0, F.substring("event_type", 1, 4), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.substring("event_type", 1, 4)))
    return e.select("event_type", s.alias("s")).rollup("event_type").agg(F.round(F.avg("s"), 6).alias("acc"), F.count("*").alias("n"), F.grouping("event_type").cast("int").alias("overall"))


def q_aggregate_evaluation(spark, d):
    """Averages over all rows, a conditional rate over those with mined golds, zero where there are none."""
    f = fixture(spark, d).withColumns({"em": exact_match(F.col("pred"), F.col("golds")), "mined": F.contains("pred", F.lit("th"))})
    return f.groupBy("lang").agg(
        F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.count_if("mined").alias("mined"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("mined"), F.col("em"))), F.nullif(F.count_if("mined"), F.lit(0))), F.lit(0.0)), 6).alias("em_given_mined"),
    )


def knn_judgement(spark, d: str, k: int = 3) -> DataFrame:
    """Votes of each vector's k nearest labelled others by L2: better minus worse, against the balance of all labels."""
    from orrery.operators.vectors import embeddings, top_k

    e = embeddings(spark, d)
    labelled = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    train = e.join(labelled, "id")
    votes = top_k(e.select("id", "v"), train.select("id", "v"), k, "l2", same=True).join(labelled.withColumnRenamed("id", "doc_id"), "doc_id")
    v = votes.groupBy("qid").agg((F.sum("quality") - F.sum(1 - F.col("quality"))).alias("delta"))
    t = train.agg(((F.avg("quality") * 2 - 1) * k).cast("int").alias("threshold"))
    return v.join(F.broadcast(t), F.lit(True)).select("qid", "delta", F.when(F.col("delta") > F.col("threshold"), "ir_better").when(F.col("delta") < F.col("threshold"), "ir_worse").otherwise("ir_same").alias("judgement"))


def q_knn_judge(spark, d):
    return knn_judgement(spark, d)


def q_item_vs_batch_means(spark, d):
    """A meter weighed by items and by batches of 100 events in order of arrival."""
    e = table(spark, d, "events").select("value", "event_type", F.expr("event_id div 100").alias("batch"))
    b = e.groupBy("batch").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.count("*").alias("n"))
    return b.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("item_mean"), F.round(F.avg("m"), 6).alias("batch_mean"), F.count("*").alias("batches"))


QUERIES = {
    "em_sub_em": q_em, "em_regex_first": q_em_regex_first, "token_prf": q_token_prf, "token_f1_core": q_token_f1_core, "retrieval_recall_precision": q_retrieval_at_k,
    "exam_accuracy_rollup": q_exam_accuracy_rollup, "aggregate_evaluation": q_aggregate_evaluation, "knn_judge": q_knn_judge, "item_vs_batch_means": q_item_vs_batch_means,
}

#: norm() and tokens as DuckDB macros are not allowed in one statement, so they are spelled out.


def _norm(x: str) -> str:
    return rf"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda t: t not in ('', 'a', 'an', 'the')), ' ')"


_FIX = "f as (select doc_id, lang, source, string_split(split_part(text, chr(10), 1), ' ') as t from documents), x as (select doc_id, lang, source, array_to_string(t[1:6], ' ') as pred, [array_to_string(t[1:4], ' '), array_to_string(t[2:6], ' '), 'The ' || array_to_string(t[1:6], ' ') || '!'] as golds from f)"
_TOKENS = (
    f"with {_FIX}, g as (select doc_id, unnest(golds) as gold, generate_subscripts(golds, 1) as gi, pred from x), n as (select doc_id, gi, {_norm('pred')} as p, {_norm('gold')} as g from g),"
    " l as (select *, list_filter(string_split(p, ' '), lambda t: t <> '') as pt, list_filter(string_split(g, ' '), lambda t: t <> '') as gt from n),"
    " pc as (select doc_id, gi, tok, count(*) as c from (select doc_id, gi, unnest(pt) as tok from l) group by all), gc as (select doc_id, gi, tok, count(*) as c from (select doc_id, gi, unnest(gt) as tok from l) group by all),"
    " o as (select doc_id, gi, sum(least(pc.c, gc.c)) as same from pc join gc using (doc_id, gi, tok) group by all),"
    " m as (select l.*, coalesce(same, 0)::double as same, len(pt) as np, len(gt) as ng, (p in ('yes','no','noanswer') or g in ('yes','no','noanswer')) and p <> g as closed from l left join o using (doc_id, gi))"
)
_L2 = """with e as (select vec_id as id, embedding::double[] as v from embeddings), t as (select e.*, quality from e join labels on doc_id = id),
s as (select a.id as qid, t.quality, row_number() over (partition by a.id order by round(list_inner_product(a.v, a.v) + list_inner_product(t.v, t.v) - 2 * list_inner_product(a.v, t.v), 9), t.id) as rank from e a join t on a.id <> t.id),
v as (select qid, (sum(quality) - sum(1 - quality))::bigint as delta from s where rank <= 3 group by qid), h as (select trunc((avg(quality) * 2 - 1) * 3)::int as threshold from t)"""
_IP5 = "e as (select vec_id as id, embedding::double[] as v from embeddings), s as (select a.id as qid, b.id as doc_id, row_number() over (partition by a.id order by round(list_inner_product(a.v, b.v), 9) desc, b.id) as rank from e a join e b on a.id <> b.id)"
ORACLE_SQL = {
    "em_sub_em": f"with {_FIX} select doc_id, list_bool_or([{_norm('golds[1]')} = {_norm('pred')}, {_norm('golds[2]')} = {_norm('pred')}, {_norm('golds[3]')} = {_norm('pred')}])::int as em, (contains({_norm('pred')}, {_norm('golds[1]')}) or contains({_norm('pred')}, {_norm('golds[2]')}))::int as sub_em, ({_norm('golds[1]')} = {_norm('pred')} or {_norm('golds[2]')} = {_norm('pred')})::int as em_two from x",
    "em_regex_first": "select n_nationkey, regexp_full_match(n_name, '(?i)[a-n].*')::int as em from nation",
    "token_prf": _TOKENS + " select doc_id, round(max(case when closed or same = 0 then 0 else 2 * same / (np + ng) end), 6) as f1, round(max(case when closed or same = 0 then 0 else same / np end), 6) as precision, round(max(case when closed or same = 0 then 0 else same / ng end), 6) as recall from m where gi <= 2 group by doc_id",
    "token_f1_core": _TOKENS + " select doc_id, round(case when np = 0 and ng = 0 then 1 when np = 0 or ng = 0 or same = 0 then 0 else 2 * same / (np + ng) end, 6) as f1, 1.0::double as f1_none from m where gi = 2",
    "retrieval_recall_precision": f"with {_IP5}, g as (select doc_id as qid, lower(string_split(text, ' ')[2]) as gold from documents), h as (select s.qid, contains({_norm('d.text')}, {_norm('g.gold')})::int as hit from s join documents d using (doc_id) join g on g.qid = s.qid where rank <= 5) select qid, coalesce(max(hit), 0) as recall, round(coalesce(avg(hit), 0.0), 6) as precision from h group by qid",
    "exam_accuracy_rollup": """with t as (select event_type, event_id % 2 = 0 as single, left(event_type, 4) as p, case when event_id % 3 = 0 then event_type else left(event_type, 4) end as g from events),
s as (select event_type, case when single then (p = g)::int::double when p = g then 1.0 when p <> '' and contains(g, p) then 0.5 else 0.0 end as s from t)
select event_type, round(avg(s), 6) as acc, count(*) as n, grouping(event_type)::int as overall from s group by rollup (event_type)""",
    "aggregate_evaluation": f"with {_FIX}, y as (select lang, contains(pred, 'th') as mined, ({_norm('golds[1]')} = {_norm('pred')} or {_norm('golds[2]')} = {_norm('pred')} or {_norm('golds[3]')} = {_norm('pred')})::int as em from x) select lang, count(*) as n, round(avg(em), 6) as em, count(*) filter (mined) as mined, round(coalesce(sum(em) filter (mined) / nullif(count(*) filter (mined), 0)::double, 0.0), 6) as em_given_mined from y group by lang",
    "knn_judge": _L2 + " select qid, delta, case when delta > threshold then 'ir_better' when delta < threshold then 'ir_worse' else 'ir_same' end as judgement from v, h",
    "item_vs_batch_means": "with b as (select event_id // 100 as batch, avg(value) as m, sum(value) as s, count(*) as n from events group by 1) select round(sum(s) / sum(n), 6) as item_mean, round(avg(m), 6) as batch_mean, count(*) as batches from b",
}
