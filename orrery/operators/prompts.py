"""Prompt assembly, candidate mining and the offline generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import answer_type, approximate_tokens, normalize_question
from orrery.operators.vectors import COSINE, neighbours
from orrery.sources.tables import table

SYSTEM = "Answer from the context. If it does not say, answer unknown."
#: How each prompt mode opens.
MODES = {"strict": SYSTEM, "open": "Answer the question; the context may help.", "none": "Answer the question."}


def context(passages: DataFrame, budget: int) -> DataFrame:
    """(qid, context): blocks ``Title: t``, body, in rank order, the last cut to fit the character budget, later ones left out."""
    block = F.concat(F.lit("Title: "), F.col("title"), F.lit("\n"), F.col("body"), F.lit("\n"))
    p = passages.withColumn("block", block)
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("room", F.lit(budget) - F.coalesce(F.sum(F.length("block")).over(w), F.lit(0))).where("room > 0")
    p = p.withColumn("block", F.substring("block", F.lit(1), F.col("room").cast("int")))
    return p.groupBy("qid").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x.block), "\n")).alias("context"))


def passages(spark, d: str, k: int = 3, title: int | None = None, body: int | None = None) -> DataFrame:
    """(qid, rank, title, body) of each vector's nearest; title, body: the characters that are wanted of each, cut before the join."""
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.when(F.contains("text", F.lit("\n")), F.substring(F.col("text"), F.locate("\n", "text") + 1, F.length("text"))).otherwise("").alias("body"))
    docs = docs.withColumns({c: F.substring(c, 1, most) for c, most in (("title", title), ("body", body)) if most is not None})
    return neighbours(spark, d, k, "cosine").join(docs, "doc_id").select("qid", "rank", "title", "body")


def messages(question: Column, ctx: Column, mode: Column) -> Column:
    """System and user message; an unknown mode is an error."""
    system = F.lit(None).cast("string")
    for name, text in MODES.items():
        system = F.when(mode == name, F.lit(text)).otherwise(system)
    system = F.coalesce(system, F.raise_error(F.concat(F.lit("unknown prompt mode "), mode)).cast("string"))
    user = F.when(mode == "none", F.concat(F.lit("Question: "), question)).otherwise(F.concat(F.lit("Context:\n"), F.coalesce(ctx, F.lit("")), F.lit("\n\nQuestion: "), question))
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def generated(prompt: Column) -> dict[str, Column]:
    """The offline generator: a fixed opening and the prompt, with approximate token counts."""
    answer = F.concat(F.lit("[answer] "), prompt)
    return {"answer": answer, "prompt_tokens": approximate_tokens(prompt), "completion_tokens": approximate_tokens(answer)}


def q_context_budget(spark, d):
    c = context(passages(spark, d, title=1500, body=1500), 1500)
    return c.select("qid", F.length("context").alias("chars"), F.md5("context").alias("context_md5"))


def q_chat_prompt(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), normalize_question(F.col("text")).alias("question"))
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("qid") % 3 + 1).cast("int"))
    m = q.join(context(passages(spark, d, title=1500, body=1500), 1500), "qid", "left").select("qid", mode.alias("mode"), messages(F.col("question"), F.col("context"), mode).alias("m"))
    return m.select("qid", "mode", F.col("m")[0].content.alias("system"), F.md5(F.col("m")[1].content).alias("user_md5"))


def q_synthetic_generate(spark, d):
    g = generated(F.concat(F.lit("Question: "), F.col("text")))
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(g["answer"]).alias("answer_md5"), "*").select("conv_id", "turn", "answer_md5", g["prompt_tokens"].alias("prompt_tokens"), g["completion_tokens"].alias("completion_tokens"))


def q_echo_context(spark, d):
    """The simulated answer: a fixed head and the context block cut out of the prompt."""
    p = F.concat(F.lit("Context:\n"), F.col("text"), F.lit("\n\nQuestion: ?"))
    cut = F.regexp_extract(p, r"(?s)Context:\n(.*?)\n\nQuestion:", 1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(F.concat(F.lit("Simulated answer.\n"), cut)).alias("answer_md5"))


def q_answer_type(spark, d):
    heads = F.array(*(F.lit(x) for x in ("Who ", "How many ", "When ", "Where ", "Why ")))
    q = table(spark, d, "benchmark").select("item_id", F.explode(heads).alias("head"), "text")
    return q.groupBy("head", answer_type(F.concat("head", "text")).alias("kind")).agg(F.count("*").alias("n"))


def q_logit_gates(spark, d):
    """Embeddings as logits: gates on greatest probability, margin and entropy."""
    p = F.transform("embedding", lambda x: F.exp(x.cast("double") * 8))
    e = table(spark, d, "embeddings").select("vec_id", p.alias("p")).withColumn("z", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    e = e.select("vec_id", F.array_sort(F.transform("p", lambda x: x / F.col("z")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("p"))
    e = e.select("vec_id", F.round(F.col("p")[0], 6).alias("pmax"), F.round(F.col("p")[0] - F.col("p")[1], 6).alias("margin"), F.round(-F.aggregate("p", F.lit(0.0), lambda a, x: a + x * F.log(x)), 6).alias("entropy"))
    return e.withColumn("open", (F.col("pmax") < 0.3) & (F.col("margin") < 0.1) & (F.col("entropy") > 2.0))


def q_exemplar_packing(spark, d):
    """The longest prefix of a conversation's turns that fits 2000 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("upto", F.sum(F.length("text") + 1).over(w))
    return c.groupBy("conv_id").agg(F.count_if(F.col("upto") <= 2000).alias("kept"), F.count("*").alias("turns"), F.coalesce(F.max(F.when(F.col("upto") <= 2000, F.col("upto"))), F.lit(0)).alias("chars"))


def q_step_truncation(spark, d):
    """Turns as numbered steps: the first, the last four and those with a mark stay; each gap becomes one ellipsis."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "text", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    c = c.withColumn("keep", (F.col("i") == 1) | (F.col("i") > F.col("n") - 4) | F.contains("text", F.lit("?")))
    c = c.withColumn("gap", ~F.col("keep") & F.coalesce(F.lag("keep").over(w), F.lit(True)))
    line = F.when(F.col("keep"), F.concat(F.lit("Step "), F.col("i").cast("string"), F.lit(": "), F.col("text"))).otherwise(F.lit("..."))
    s = c.where("keep or gap").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x.l), "\n\n").alias("t"), F.count_if("gap").alias("gaps"))
    return s.select("conv_id", F.md5("t").alias("steps_md5"), "gaps")


QUERIES = {
    "context_budget": q_context_budget, "chat_prompt": q_chat_prompt, "synthetic_generate": q_synthetic_generate, "echo_context": q_echo_context,
    "answer_type": q_answer_type, "logit_gates": q_logit_gates, "exemplar_packing": q_exemplar_packing, "step_truncation": q_step_truncation,
}

_PASS = COSINE + ", pa as (select qid, rank, split_part(text, chr(10), 1) as title, case when contains(text, chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end as body from r join documents using (doc_id) where rank <= 3)"
_CTX = _PASS + ", bl as (select qid, rank, 'Title: ' || title || chr(10) || body || chr(10) as block from pa), rm as (select *, 1500 - coalesce(sum(length(block)) over (partition by qid order by rank rows between unbounded preceding and 1 preceding), 0) as room from bl), cx as (select qid, trim(string_agg(left(block, room::bigint), chr(10) order by rank)) as context from rm where room > 0 group by qid)"
ORACLE_SQL = {
    "context_budget": _CTX + " select qid, length(context)::int as chars, md5(context) as context_md5 from cx",
    "chat_prompt": _CTX + f""", q as (select item_id as qid, case when ends_with(trim(text), '?') then trim(text) else trim(text) || '?' end as y, ['strict', 'open', 'none'][1 + item_id % 3] as mode from benchmark),
z as (select q.qid, mode, lower(left(y, 1)) || substr(y, 2) as question, context from q left join cx using (qid))
select qid, mode, case mode when 'strict' then '{MODES['strict']}' when 'open' then '{MODES['open']}' else '{MODES['none']}' end as system,
  md5(case when mode = 'none' then 'Question: ' || question else 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question end) as user_md5 from z""",
    "synthetic_generate": "with p as (select conv_id, turn, 'Question: ' || text as p from conversations) select conv_id, turn, md5('[answer] ' || p) as answer_md5, greatest(1, length(p) // 4)::bigint as prompt_tokens, greatest(1, length('[answer] ' || p) // 4)::bigint as completion_tokens from p",
    "echo_context": "select conv_id, turn, md5('Simulated answer.' || chr(10) || split_part(text || chr(10) || chr(10) || 'Question: ?', chr(10) || chr(10) || 'Question:', 1)) as answer_md5 from conversations",
    "answer_type": "select head, case head when 'Who ' then 'person' when 'How many ' then 'number' when 'When ' then 'date' when 'Where ' then 'location' else 'other' end as kind, count(*) as n from benchmark cross join (select unnest(['Who ', 'How many ', 'When ', 'Where ', 'Why ']) as head) group by head",
    "logit_gates": """with x as (select vec_id, unnest(embedding) as x from embeddings), p as (select vec_id, exp(x::double * 8) as e from x), q as (select vec_id, e / sum(e) over (partition by vec_id) as p, row_number() over (partition by vec_id order by e desc) as r from p),
g as (select vec_id, round(max(p), 6) as pmax, round(max(p) - max(p) filter (r = 2), 6) as margin, round(-sum(p * ln(p)), 6) as entropy from q group by vec_id) select *, pmax < 0.3 and margin < 0.1 and entropy > 2.0 as open from g""",
    "exemplar_packing": "with c as (select conv_id, sum(length(text) + 1) over (partition by conv_id order by turn) as upto from conversations) select conv_id, count(*) filter (upto <= 2000) as kept, count(*) as turns, coalesce(max(upto) filter (upto <= 2000), 0)::bigint as chars from c group by conv_id",
    "step_truncation": """with c as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n from conversations),
k as (select *, i = 1 or i > n - 4 or contains(text, '?') as keep from c), g as (select *, not keep and coalesce(lag(keep) over (partition by conv_id order by turn), true) as gap from k)
select conv_id, md5(string_agg(case when keep then 'Step ' || i || ': ' || text else '...' end, chr(10) || chr(10) order by i)) as steps_md5, count(*) filter (gap) as gaps from g where keep or gap group by conv_id""",
}
