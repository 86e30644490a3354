"""Whole flows as one lazy plan: retrieve, assemble, answer, score, roll up; and an index build with its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.metrics import _norm, exact_match, sub_match, token_f1_open
from orrery.operators.prompts import _CTX, context, generated, messages, passages
from orrery.operators.vectors import embeddings
from orrery.sources.scratch import Scratch
from orrery.sources.tables import table


def answered(spark, d: str, mode: str = "open") -> DataFrame:
    """(qid, answer, gold, prompt_tokens, completion_tokens): retrieval, context, prompt, offline generator."""
    q = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.substring_index("text", "\n", 1).alias("question"), F.element_at(F.split(F.substring_index("text", "\n", 1), " "), 1).alias("gold"))
    m = q.join(context(passages(spark, d, title=1500, body=1500), 1500), "qid").withColumn("m", messages(F.col("question"), F.col("context"), F.lit(mode)))
    g = generated(F.col("m")[1].content)
    return m.select("qid", "gold", g["answer"].alias("answer"), g["prompt_tokens"].alias("prompt_tokens"), g["completion_tokens"].alias("completion_tokens"))


def q_sequential_pipeline(spark, d):
    a = answered(spark, d)
    golds = F.array("gold")
    s = a.select("qid", "prompt_tokens", "completion_tokens", exact_match(F.col("answer"), golds).alias("em"), sub_match(F.col("answer"), golds).alias("sub_em"))
    return s.agg(F.count("*").alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("sub_em"), 6).alias("sub_em"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def q_llm_only_pipeline(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    g = generated(F.col("text"))
    f1 = token_f1_open(g["answer"], F.array(F.substring_index("text", " ", 5)))
    return c.select("conv_id", "turn", g["prompt_tokens"].alias("prompt_tokens"), F.round(f1, 6).alias("f1"))


def q_confidence_loop(spark, d):
    """Bounded confidence-gated rounds: a query with a weak best score asks again by its best hit's vector, at most three times."""
    from orrery.operators.vectors import neighbours

    with Scratch(spark) as scratch:
        return scratch.kept(_rounds(scratch.stored(neighbours(spark, d, 1, "cosine").select("qid", F.col("doc_id").alias("hit"), "score"), "nearest")))


def _rounds(n: DataFrame) -> DataFrame:
    """n: (qid, hit, score), each vector's nearest."""
    state = n.select("qid", F.col("qid").alias("asks"), "hit", "score", F.lit(1).alias("rounds"))
    nxt = n.select(F.col("qid").alias("asks"), F.col("hit").alias("n_hit"), F.col("score").alias("n_score"))
    for _ in range(2):
        s = state.select("qid", F.when(F.col("score") < 0.35, F.col("hit")).otherwise(F.col("asks")).alias("asks"), "rounds", (F.col("score") < 0.35).alias("again"))
        state = s.join(nxt, "asks").select("qid", "asks", F.col("n_hit").alias("hit"), F.col("n_score").alias("score"), (F.col("rounds") + F.col("again").cast("int")).alias("rounds"))
    return state.groupBy("rounds").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("score"))


def q_index_build(spark, d):
    """Manifest of a list-partitioned build: rows, lists and bytes a list."""
    e = embeddings(spark, d)
    return e.groupBy("label").agg(F.count("*").alias("ntotal"), F.sum(F.size("v").cast("long") * 4).alias("bytes"), F.min("id").alias("first"))


QUERIES = {"sequential_pipeline": q_sequential_pipeline, "llm_only_pipeline": q_llm_only_pipeline, "confidence_loop": q_confidence_loop, "index_build_manifest": q_index_build}
_P = "q as (select doc_id as qid, split_part(text, chr(10), 1) as question, string_split(split_part(text, chr(10), 1), ' ')[1] as gold from documents), pr as (select q.qid, gold, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question as p from q join cx using (qid)), an as (select *, '[answer] ' || p as answer from pr)"
_TOKENS = "list_filter(string_split({x}, ' '), lambda t: t <> '')"
ORACLE_SQL = {
    "llm_only_pipeline": f"""with c as (select conv_id, turn, text, '[answer] ' || text as a, array_to_string(string_split(text, ' ')[1:5], ' ') as g from conversations where role = 'user'),
n as (select conv_id, turn, text, {_TOKENS.format(x=_norm('a'))} as p, {_TOKENS.format(x=_norm('g'))} as t from c),
m as (select *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(t, lambda y: y = x))))), 0) as same from n)
select conv_id, turn, greatest(1, length(text) // 4)::bigint as prompt_tokens, round(case when len(p) = 0 and len(t) = 0 then 1.0 when same = 0 then 0.0 else 2 * same / (len(p) + len(t)) end, 6)::double as f1 from m""",
    "sequential_pipeline": _CTX + f", {_P} select count(*) as n, round(avg(({_norm('gold')} = {_norm('answer')})::int), 6) as em, round(avg(contains({_norm('answer')}, {_norm('gold')})::int), 6) as sub_em, sum(greatest(1, length(p) // 4))::bigint as prompt_tokens, sum(greatest(1, length(answer) // 4))::bigint as completion_tokens from an",
    "confidence_loop": """with e as (select vec_id as id, embedding::double[] as v from embeddings), s as (select a.id as qid, b.id as hit, round(list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-12) * (sqrt(list_inner_product(b.v, b.v)) + 1e-12)), 9) as s from e a join e b on a.id <> b.id),
n as (select qid, hit, round(s, 6) as score from s qualify row_number() over (partition by qid order by s desc, hit) = 1),
r1 as (select qid, qid as asks, hit, score, 1 as rounds from n),
r2 as (select r.qid, n.qid as asks, n.hit, n.score, rounds + (r.score < 0.35)::int as rounds from r1 r join n on n.qid = case when r.score < 0.35 then r.hit else r.asks end),
r3 as (select r.qid, n.qid as asks, n.hit, n.score, rounds + (r.score < 0.35)::int as rounds from r2 r join n on n.qid = case when r.score < 0.35 then r.hit else r.asks end)
select rounds, count(*) as n, round(avg(score), 5) as score from r3 group by rounds""",
    "index_build_manifest": "select label, count(*) as ntotal, sum(len(embedding) * 4)::bigint as bytes, min(vec_id) as first from embeddings group by label",
}
