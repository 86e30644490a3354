"""Lexical ranking (BM25), lexical reranking, page text and query snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orrery.functions.text import sentences
from orrery.sources.tables import table

K1, B = 1.5, 0.75


def terms(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")


def q_bm25_topk(spark, d):
    from orrery.operators.postings import bm25_stored

    docs = table(spark, d, "documents").select("doc_id", "text")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return bm25_stored(docs, queries, 10)


def q_lexical_rerank(spark, d):
    """The vector neighbours of each document reranked by the share of its title's terms that they hold."""
    from orrery.operators.vectors import neighbours

    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(terms(F.substring_index("text", "\n", 1))).alias("title"), F.array_distinct(terms(F.col("text"))).alias("all"))
    n = neighbours(spark, d, 5, "cosine").join(docs.select("doc_id", "all"), "doc_id").join(docs.select(F.col("doc_id").alias("qid"), "title"), "qid")
    s = n.select("qid", "doc_id", F.col("rank").alias("first"), F.round(F.size(F.array_intersect("title", "all")) / F.greatest(F.lit(1), F.size("title")), 6).alias("lexical"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("lexical"), "first"))).select("qid", "rank", "doc_id", "lexical")


def page_text(html: Column) -> Column:
    """Text of a page by patterns: scripts, styles and comments out, tags to spaces, five common references decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def q_html_text_regex(spark, d):
    t = page_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(t).alias("text_md5"), F.length(t).alias("chars"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.deaf = 0

    def handle_starttag(self, tag, attrs):
        self.deaf += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.deaf -= tag in ("script", "style") and self.deaf > 0

    def handle_data(self, data):
        if not self.deaf and data.strip():
            self.out.append(data.strip())


@F.pandas_udf(StringType())
def parsed_text(html: pd.Series) -> pd.Series:
    """Text of a page by the standard library's parser, pieces joined by a space."""

    def one(x: str | None) -> str:
        p = _Text()
        p.feed(x or "")
        p.close()
        return " ".join(p.out)

    return html.map(one)


def q_html_text_parser(spark, d):
    p = table(spark, d, "pages").select("page_id", parsed_text("html").alias("t"))
    return p.select("page_id", F.length("t").alias("chars"), F.size(F.split("t", " ")).alias("words"))


def set_f1(a: Column, b: Column) -> Column:
    same = F.size(F.array_intersect(a, b))
    return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def snippets(rows: DataFrame, key: str, text: str, query: str, context: int = 200, least: float = 0.2) -> DataFrame:
    """(key, x): the stretch around the sentence nearest to the query by word-set F1 (the first of the best), else the text's beginning.

    A sentence is split and compared once, a batch at a time. Null text: null; null query: no terms.
    """

    def near(t: str, q: str) -> str:
        asked, best, found = set(re.findall(r"[a-z0-9]+", q.lower())), 0.0, ""
        for x in re.split(r"(?<=[.!?])[ \t\n\v\f\r]+", t):
            words = set(re.findall(r"[a-z0-9]+", x.lower()))
            same = len(words & asked)
            f = round(2 * same / (len(words) + len(asked)), 9) if same else 0.0
            if f > best:
                best, found = f, x
        if best <= least:
            return t[: 2 * context]
        start = max(0, t.find(found) - context)
        return t[start : start + len(found) + 2 * context]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [None if t is None else near(t, q or "") for t, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.string())], [key, "x"])

    return rows.select(F.col(key), F.col(text).alias("_text"), F.col(query).alias("_query")).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, x string")


def q_snippet_context(spark, d):
    docs = table(spark, d, "documents").withColumn("q", F.element_at(sentences(F.col("text")), -1))
    return snippets(docs, "doc_id", "text", "q").select("doc_id", F.md5("x").alias("snippet_md5"), F.length("x").alias("chars"))


QUERIES = {"bm25_topk": q_bm25_topk, "lexical_rerank": q_lexical_rerank, "html_text_regex": q_html_text_regex, "html_text_parser": q_html_text_parser, "snippet_context": q_snippet_context}
ORACLE_SQL = {
    "bm25_topk": r"""with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as term from documents),
tf as (select doc_id, term, count(*) as tf from t group by all), dl as (select doc_id, sum(tf) as dl from tf group by all), df as (select term, count(*) as df from tf group by all),
n as (select (select count(*) from documents) as n, (select sum(dl) from dl) as total),
q as (select distinct item_id as qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as term from benchmark),
h as (select qid, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl * n / total))), 6) as score from q join df using (term) join tf using (term) join dl using (doc_id), n group by all),
r as (select *, row_number() over (partition by qid order by score desc, doc_id)::int as rank from h) select qid, rank, doc_id, round(score, 4) as score from r where rank <= 10""",
    "lexical_rerank": r"""with e as (select vec_id as id, embedding::double[] as v from embeddings), s as (select a.id as qid, b.id as doc_id, row_number() over (partition by a.id order by round(list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-12) * (sqrt(list_inner_product(b.v, b.v)) + 1e-12)), 9) desc, b.id) as first from e a join e b on a.id <> b.id),
d as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+'), lambda t: t <> '')) as title, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as "all" from documents),
x as (select s.qid, s.doc_id, first, round(len(list_intersect(q.title, d."all")) / greatest(1, len(q.title))::double, 6) as lexical from s join d using (doc_id) join d q on q.doc_id = s.qid where first <= 5)
select qid, row_number() over (partition by qid order by lexical desc, first)::int as rank, doc_id, lexical from x""",
    "html_text_regex": r"""with x as (select page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as x from pages),
y as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) as t from x)
select page_id, md5(t) as text_md5, length(t)::int as chars from y""",
    "snippet_context": r"""with s as (select doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) as s from documents),
u as (select doc_id, text, unnest(s) as x, generate_subscripts(s, 1) as i, s[-1] as q from s),
w as (select *, list_distinct(list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda t: t <> '')) as xt, list_distinct(list_filter(regexp_split_to_array(lower(q), '[^a-z0-9]+'), lambda t: t <> '')) as qt from u),
f as (select doc_id, text, x, i, round(case when len(list_intersect(xt, qt)) = 0 then 0 else 2.0::double * len(list_intersect(xt, qt)) / (len(xt) + len(qt)) end, 9) as f from w),
b as (select *, row_number() over (partition by doc_id order by f desc, i) as r from f),
o as (select doc_id, case when f > 0.2 then substr(text, greatest(1, instr(text, x) - 200), length(x) + 400) else left(text, 400) end as t from b where r = 1)
select doc_id, md5(t) as snippet_md5, length(t)::int as chars from o""",
}
