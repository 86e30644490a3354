"""Answer candidates mined from passages: phrases, numbers, years and dates; merged by key; without those inside a better one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.prompts import _PASS, passages

#: What a candidate looks like, what a mention weighs, sentence starters that are none.
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
PATTERNS = {
    "phrase": (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b", 1.0),
    "number": (r"\b(\d{1,4})\b", 0.5),
    "year": (r"\b(1[5-9]\d{2}|20\d{2})\b", 1.0),
    "date": (r"(?i)\b((?:" + MONTHS + r")\s+\d{1,2}(?:,?\s+\d{4})?)\b", 1.0),
}
STARTERS = ("The", "A", "An")
EDGES = " \t\r\n\"'`.,;:()[]{}"
#: Words of a form that may replace a shorter one; candidates of a query that are compared with each other.
MOST_WORDS, MOST = 6, 50


def mentions(rows: DataFrame) -> DataFrame:
    """(qid, phrase, score): every mention in passages (qid, rank from 1, title, body), weighed by 1 / rank."""
    # engines differ about word edges beyond ASCII
    text = F.regexp_replace(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))), r"[^\x00-\x7F]", "_")

    def weighed(pattern: str, weight: float) -> Column:
        return F.transform(F.regexp_extract_all("_text", F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("phrase"), (F.lit(weight) / F.col("rank")).alias("score")))

    found = [weighed(*x) for x in PATTERNS.values()]
    flat = rows.withColumn("_text", text).select("qid", F.explode(F.concat(*found)).alias("c")).select("qid", "c.phrase", "c.score")
    return flat.where(~F.col("phrase").isin(*STARTERS) & ((F.length("phrase") >= 3) | F.col("phrase").rlike("^[0-9]")))


def key_of(phrase: Column) -> Column:
    """Lower case, runs of white space as one space, no punctuation at the edges."""
    return F.btrim(F.regexp_replace(F.lower(phrase), r"\s+", " "), F.lit(EDGES))


def merged(candidates: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """(qid, key, phrase, score): scores summed by key; the longest form of at most ``most_words`` words stands for it, the first by code point of equally long ones."""
    words = F.size(F.split(F.trim("phrase"), r"\s+"))
    forms = candidates.groupBy("qid", key_of(F.col("phrase")).alias("key"), "phrase").agg(F.sum("score").alias("score")).where("key <> ''")
    first = F.min_by("phrase", F.struct(-(words <= most_words).cast("int"), -F.length("phrase"), "phrase"))
    return forms.groupBy("qid", "key").agg(F.round(F.sum("score"), 6).alias("score"), first.alias("phrase"))


def best(candidates: DataFrame, most: int) -> DataFrame:
    """With rank: by score, then key."""
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))
    return candidates.withColumn("rank", r).where(F.col("rank") <= most)


def distinct_phrases(candidates: DataFrame) -> DataFrame:
    """``candidates`` (qid, key, score, ..) without those whose key stands inside a better one's: by score, then by the key's length, then by key.

    A query's candidates are one group, so ``best`` comes first. What is inside a dropped one is inside a kept one too, so
    each is looked for in all before it, joined by line ends that no key has.
    """
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.desc(F.length("key")), "key"))
    placed = candidates.withColumn("_order", order)
    dealt = placed.repartition("qid").sortWithinPartitions("qid", "_order")
    place = placed.columns.index("key"), placed.columns.index("qid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = object(), ""
        for b in batches:
            keep = []
            for i, (key, q) in enumerate(zip(*(b.column(p).to_pylist() for p in place), strict=True)):
                if q != at:
                    at, before = q, ""
                if key not in before:
                    keep.append(i)
                    before += "\n" + key
            yield b.take(pa.array(keep, pa.int64()))

    return dealt.mapInArrow(run, placed.schema).drop("_order")


def mined(spark, d: str) -> DataFrame:
    return merged(mentions(passages(spark, d)))


def q_mine_regex_candidates(spark, d):
    return best(mined(spark, d), 10).select("qid", "rank", "phrase", "score")


def q_distinct_candidates(spark, d):
    """Of each query's fifty best candidates, those that no better one holds."""
    return distinct_phrases(best(mined(spark, d), MOST)).select("qid", "key", "phrase", "score")


def q_candidate_bias(spark, d):
    """Softmax over a query's candidates spread on their words, summed by word, capped."""
    w = Window.partitionBy("qid")
    m = mined(spark, d)
    m = m.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / 2.0)).withColumn("p", F.col("e") / F.sum("e").over(w))
    t = m.select("qid", "p", F.explode(F.split("key", " ")).alias("word")).groupBy("qid", "word").agg(F.round(F.least(F.sum("p") * 10, F.lit(2.0)), 6).alias("bias"))
    return t.groupBy("qid").agg(F.count("*").alias("words"), F.round(F.sum("bias"), 6).alias("total"), F.round(F.max("bias"), 6).alias("most"))


QUERIES = {"mine_regex_candidates": q_mine_regex_candidates, "distinct_candidates": q_distinct_candidates, "candidate_bias": q_candidate_bias}

_MENTIONS = " union all ".join(f"select qid, unnest(regexp_extract_all(t, '{p}', 1)) as phrase, {w}::double / rank as score from tx" for p, w in PATTERNS.values())
_MINED = _PASS + rf""", tx as (select qid, rank, regexp_replace(coalesce(title, '') || chr(10) || coalesce(body, ''), '[^\x00-\x7F]', '_', 'g') as t from pa),
mn as (select * from ({_MENTIONS}) where phrase not in {STARTERS} and (length(phrase) >= 3 or regexp_matches(phrase, '^[0-9]'))),
ky as (select qid, phrase, score, trim(regexp_replace(lower(phrase), '\s+', ' ', 'g'), ' "''`.,;:()[]{{}}' || chr(9) || chr(10) || chr(13)) as key, len(regexp_split_to_array(trim(phrase), '\s+')) <= {MOST_WORDS} as short from mn),
mi as (select qid, key, round(sum(score), 6) as score, first(phrase order by short desc, length(phrase) desc, phrase) as phrase from ky where key <> '' group by qid, key),
rk as (select *, row_number() over (partition by qid order by score desc, key)::int as rank from mi)"""
ORACLE_SQL = {
    "mine_regex_candidates": _MINED + " select qid, rank, phrase, score from rk where rank <= 10",
    "distinct_candidates": _MINED + f", oo as (select *, row_number() over (partition by qid order by score desc, length(key) desc, key) as o from rk where rank <= {MOST}) select qid, key, phrase, score from oo where not exists (select 1 from oo b where b.qid = oo.qid and b.o < oo.o and contains(b.key, oo.key))",
    "candidate_bias": _MINED + ", ex as (select qid, key, exp((score - max(score) over (partition by qid)) / 2.0::double) as e from mi), pr as (select qid, key, e / sum(e) over (partition by qid) as p from ex), wd as (select qid, p, unnest(string_split(key, ' ')) as word from pr), bi as (select qid, word, round(least(sum(p) * 10, 2.0), 6) as bias from wd group by all) select qid, count(*) as words, round(sum(bias), 6) as total, round(max(bias), 6) as most from bi group by qid",
}
