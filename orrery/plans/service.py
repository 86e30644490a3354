"""The service's three ways to an answer, each one plan over all questions: by prompt, by scored candidates, by biased decoding.

prompt    retrieve, assemble the context, ask the generator.
stage1    retrieve, mine candidates, score the best of them as completions, with their priors; the best one is the
          answer. A question without candidates is answered by the generator from the scoring prompt (``stage1_fallback``).
bias      retrieve, mine, leave out candidates inside better ones, spread the rest's weights on their words; the
          generator is asked with these biases.

Generator and scorer are columns, so a model comes in as a pandas UDF; the deterministic stand-ins are the offline
generator and a score by length. Retrieval is made once and shared by all three. Blank questions raise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import mining
from orrery.operators.prompts import _CTX, _PASS, context, generated, messages, passages
from orrery.sources.scratch import Scratch
from orrery.sources.tables import table

#: Candidates that are mined, scored, and turned into biases; weight of the prior; temperature, strength and cap of a word's bias; characters of the context.
MINED, SCORED, BIASED, PRIOR, TEMPERATURE, STRENGTH, CAP, BUDGET = 40, 20, 40, 0.5, 2.0, 10.0, 2.0, 1500


def by_length(candidate: Column) -> Column:
    """The stand-in for a model's log-probability of a completion, normalised by its length."""
    n = F.length(candidate).cast("double")
    return -n / F.sqrt(n)


def required(question: Column) -> Column:
    q = F.trim(F.coalesce(question, F.lit("")))
    return F.when(q == "", F.raise_error(F.lit("question must be non-empty")).cast("string")).otherwise(q)


def by_prompt(questions: DataFrame, hits: DataFrame, generate: Callable[[Column], dict[str, Column]] = generated) -> DataFrame:
    """(version, qid, answer, candidates, biased, bias_total) for questions (qid, question) and passages (qid, rank, title, body)."""
    m = questions.join(context(hits, BUDGET), "qid", "left").withColumn("m", messages(required(F.col("question")), F.col("context"), F.lit("open")))
    return m.select(F.lit("prompt").alias("version"), "qid", generate(F.col("m")[1].content)["answer"].alias("answer"), F.lit(0).cast("long").alias("candidates"), F.lit(0).cast("long").alias("biased"), F.lit(0.0).alias("bias_total"))


def by_candidates(questions: DataFrame, mined: DataFrame, score: Callable[[Column], Column] = by_length, generate: Callable[[Column], dict[str, Column]] = generated) -> DataFrame:
    """The same from mined candidates (qid, key, phrase, score, rank)."""
    w = Window.partitionBy("qid")
    top = mined.where(F.col("rank") <= SCORED)
    prior = F.when(F.sum("score").over(w) > 0, F.col("score") / F.sum("score").over(w)).otherwise(1 / F.count("*").over(w))
    final = F.round(score(F.col("key")) + PRIOR * F.log(prior + 1e-12), 6)
    best = top.withColumn("final", final).groupBy("qid").agg(F.count("*").alias("n"), F.min_by("phrase", F.struct(-F.col("final"), "key")).alias("phrase"))
    out = questions.join(best, "qid", "left")
    fallback = generate(F.concat(F.lit("Question: "), required(F.col("question"))))["answer"]
    version = F.when(F.col("phrase").isNull(), "stage1_fallback").otherwise("stage1")
    return out.select(version.alias("version"), "qid", F.coalesce("phrase", fallback).alias("answer"), F.coalesce("n", F.lit(0)).cast("long").alias("candidates"), F.lit(0).cast("long").alias("biased"), F.lit(0.0).alias("bias_total"))


def word_biases(mined: DataFrame) -> DataFrame:
    """(qid, candidates, biases: map of word to bias) from candidates: a softmax over those outside better ones, summed by word, capped."""
    w = Window.partitionBy("qid")
    kept = mining.distinct_phrases(mined).where(F.col("rank") <= BIASED)
    e = kept.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / TEMPERATURE))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(w))
    words = p.select("qid", "p", F.explode(F.split("key", " ")).alias("word")).groupBy("qid", "word").agg(F.round(F.least(F.sum("p") * STRENGTH, F.lit(CAP)), 6).alias("bias"))
    biases = words.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bias")))).alias("biases"))
    return kept.groupBy("qid").agg(F.count("*").alias("candidates")).join(biases, "qid")


def by_bias(questions: DataFrame, hits: DataFrame, mined: DataFrame, generate: Callable[[Column, Column], Column] = lambda prompt, biases: generated(prompt)["answer"]) -> DataFrame:
    """The same with biased decoding; generate: (prompt, map of biases) to answer."""
    m = questions.join(context(hits, BUDGET), "qid", "left").join(word_biases(mined), "qid", "left").withColumn("m", messages(required(F.col("question")), F.col("context"), F.lit("open")))
    total = F.round(F.aggregate(F.map_values("biases"), F.lit(0.0), lambda a, x: a + x), 6)
    return m.select(
        F.lit("bias").alias("version"), "qid", generate(F.col("m")[1].content, F.col("biases")).alias("answer"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
        F.coalesce(F.size("biases"), F.lit(0)).cast("long").alias("biased"), F.coalesce(total, F.lit(0.0)).alias("bias_total"),
    )


def served(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """All three versions' rows for every question."""
    with Scratch(questions.sparkSession) as s:
        hits = s.stored(hits, "hits")
        mined = s.stored(mining.best(mining.merged(mining.mentions(hits)), MINED), "mined")
        return s.kept(by_prompt(questions, hits).union(by_candidates(questions, mined)).union(by_bias(questions, hits, mined)))


def q_service_versions(spark, d):
    """Every document with a vector asks by its first line."""
    q = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.trim(F.substring_index("text", "\n", 1)).alias("question")).where("question <> ''")
    q = q.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid")), "qid", "left_semi")
    return served(q, passages(spark, d)).select("version", "qid", F.md5("answer").alias("answer_md5"), "candidates", "biased", "bias_total")


QUERIES = {"service_versions": q_service_versions}
ORACLE_SQL = {
    "service_versions": _CTX + mining._MINED[len(_PASS) :] + f""", q as (select doc_id as qid, trim(split_part(text, chr(10), 1)) as question from documents where trim(split_part(text, chr(10), 1)) <> '' and doc_id in (select id from e)),
pr as (select qid, '[answer] Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || question as answer from q left join cx using (qid)),
sc as (select qid, key, phrase, round(-length(key) / sqrt(length(key)) + {PRIOR}::double * ln(score / sum(score) over (partition by qid) + 1e-12), 6) as final from rk where rank <= {SCORED}),
bs as (select qid, count(*) as n, first(phrase order by final desc, key) as phrase from sc group by qid),
oo as (select *, row_number() over (partition by qid order by score desc, length(key) desc, key) as o from rk where rank <= {MINED}),
dp as (select * from oo where not exists (select 1 from oo b where b.qid = oo.qid and b.o < oo.o and contains(b.key, oo.key))),
ex as (select qid, key, exp((score - max(score) over (partition by qid)) / {TEMPERATURE}::double) as e from dp), sm as (select qid, key, e / sum(e) over (partition by qid) as p from ex),
wd as (select qid, word, round(least(sum(p) * {STRENGTH}, {CAP}), 6) as bias from (select qid, p, unnest(string_split(key, ' ')) as word from sm) group by all),
bi as (select qid, count(*) as biased, round(sum(bias), 6) as bias_total from wd group by qid), nc as (select qid, count(*) as n from dp group by qid)
select 'prompt' as version, qid, md5(answer) as answer_md5, 0::bigint as candidates, 0::bigint as biased, 0.0::double as bias_total from pr
union all select case when phrase is null then 'stage1_fallback' else 'stage1' end, qid, md5(coalesce(phrase, '[answer] Question: ' || question)), coalesce(n, 0), 0, 0.0 from q left join bs using (qid)
union all select 'bias', qid, md5(answer), coalesce(n, 0), coalesce(biased, 0), coalesce(bias_total, 0.0) from pr left join nc using (qid) left join bi using (qid)""",
}
