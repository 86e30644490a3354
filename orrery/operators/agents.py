"""What search agents need round by round: page search and fetch, evidence formatting, step editing, candidate handling, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import slug
from orrery.operators.lexical import page_text
from orrery.operators.postings import bm25_stored
from orrery.operators.mining import _MINED, mined
from orrery.operators.prompts import _PASS, passages
from orrery.sources.tables import table


def fetch(urls: DataFrame, pages: DataFrame, most: int = 8000) -> DataFrame:
    """(req, url, text): the first ``most`` characters of each page's text; unknown urls give an error text. Each url is read once."""
    known = urls.select("url").distinct().join(pages.select("url", page_text(F.col("html")).alias("t")), "url", "left")
    return urls.join(known, "url", "left").select("req", "url", F.coalesce(F.substring("t", 1, most), F.lit("Error: page not found")).alias("text"))


def q_page_fetch(spark, d):
    p = table(spark, d, "pages")
    urls = p.select(F.col("page_id").alias("req"), F.explode(F.array("url", F.concat(F.col("url"), F.lit("/missing")))).alias("url"))
    first = p.where("html is not null").groupBy("url").agg(F.min_by("html", "page_id").alias("html"))  # of an url's pages
    return fetch(urls, first).select("req", "url", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def q_page_search(spark, d):
    """BM25 over the pages' text stands in for a web search; the queries are the benchmark's items."""
    docs = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), page_text(F.col("html")).alias("text"))
    return bm25_stored(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), 5)


def q_evidence_format(spark, d):
    """Numbered evidence blocks of each query's passages."""
    b = F.concat(F.lit("**Web Page "), F.col("rank").cast("string"), F.lit(":**\n"), F.to_json(F.struct("title", F.substring("body", 1, 50).alias("snippet"))), F.lit("\n"))
    p = passages(spark, d, body=50).withColumns({"title": F.regexp_replace("title", r'["\\\x00-\x1f]', " "), "body": F.regexp_replace("body", r'["\\\x00-\x1f]', " ")})
    e = p.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", b.alias("b")))), lambda x: x.b), "\n").alias("t"))
    return e.select("qid", F.md5("t").alias("evidence_md5"))


def replace_steps(old: Column, new: Column) -> Column:
    """Steps (map number -> text) with those of ``new`` put in; the text DELETE takes a step out."""
    return F.map_filter(F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new), lambda k, v: v != "DELETE")


def q_replace_steps(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m"))))).alias("old"))
    new = F.create_map(F.lit(1).cast("long"), F.lit("edited"), F.lit(2).cast("long"), F.lit("DELETE"), F.lit(99).cast("long"), F.lit("added"))
    s = c.select("conv_id", F.array_sort(F.map_entries(replace_steps(F.col("old"), new))).alias("s"))
    return s.select("conv_id", F.size("s").alias("steps"), F.array_join(F.transform("s", lambda x: F.concat(x.key.cast("string"), F.lit("="), x.value)), ";").alias("all"))


#: Units of a number, words inside a name, words of a name or of a span that stands for itself at most.
UNITS = "pages?|years?|months?|days?|km|kilometers?|miles?|meters?|feet|ft|inches?|%|dollars?|usd|euros?|pounds?"
PARTICLES = "de|da|del|van|von|al|bin|ibn|la|le|of"
SPAN_WORDS = 6
SPANS = {
    "number": r"(?i)\b(\d{1,6}(?:\.\d+)?(?:\s+(?:" + UNITS + r"))?)\b",
    "year": r"\b(1[5-9]\d{2}|20\d{2})\b",
    "name": r"\b((?:[A-Z][a-z]+|[A-Z]\.)(?:\s+(?:[A-Z][a-z]+|[A-Z]\.|" + PARTICLES + r"))*)\b",
}
#: What a question of each kind takes from a span.
WANTED = {"number": ("number",), "date": ("number", "year"), "person": ("name",), "location": ("name",)}


def atomic_spans(x: Column, kind: Column) -> Column:
    """The atomic parts of a span for a kind of answer, in order, repeats included: numbers with their units, years, names; and the span itself if it is short and no sentence."""
    clean = F.trim(F.regexp_replace(x, r"\s+", " "))
    found = F.array().cast("array<string>")
    for name, pattern in SPANS.items():
        kinds = [k for k, names in WANTED.items() if name in names]
        found = F.concat(found, F.when(kind.isin(*kinds), F.regexp_extract_all(x, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>")))
    found = F.filter(F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.size(F.split(s, " ")) <= SPAN_WORDS)
    own = (clean != "") & (F.size(F.split(clean, " ")) <= SPAN_WORDS) & ~clean.rlike(r"[.!?;]|,.*,")
    return F.concat(found, F.when(own, F.array(clean)).otherwise(F.array().cast("array<string>")))


def distinct_spans(rows: DataFrame, key: str) -> DataFrame:
    """(key, span): each of rows' ``spans`` once, whatever its case; the first form stays."""
    each = rows.select(key, F.posexplode("spans").alias("at", "span"))
    return each.groupBy(key, F.lower("span").alias("_low")).agg(F.min_by("span", "at").alias("span")).select(key, "span")


def q_atomic_spans(spark, d):
    """Of every document's lines, by four kinds of question in turn."""
    kinds = F.array(*map(F.lit, WANTED))
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text, "\n")).alias("n", "line"), F.element_at(kinds, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("kind"))
    spans = lines.select("doc_id", F.concat_ws(":", "doc_id", "n").alias("line_id"), atomic_spans(F.col("line"), F.col("kind")).alias("spans"))
    own = distinct_spans(spans, "line_id").groupBy(F.substring_index("line_id", ":", 1).cast("long").alias("doc_id"))
    return own.agg(F.count("*").alias("spans"), F.md5(F.array_join(F.array_sort(F.collect_list("span")), "|")).alias("spans_md5"))


def candidates(x: Column) -> Column:
    """Phrases and scores from a JSON list, whatever its elements are: objects (candidate or phrase; score, llm_score or prior), pairs, or plain values (score 0); blank phrases out."""
    text = lambda v, at: F.trim(F.coalesce(F.try_variant_get(v, at, "string"), F.lit("")))
    number = lambda v, at: F.try_variant_get(v, at, "double")

    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        named = F.when(F.coalesce(F.try_variant_get(v, "$.candidate", "string"), F.lit("")) != "", text(v, "$.candidate")).otherwise(text(v, "$.phrase"))
        scored = F.coalesce(*(number(v, f"$.{k}") for k in ("score", "llm_score", "prior")), F.lit(0.0))
        pair = kind.startswith("ARRAY") & F.try_variant_get(v, "$[1]", "variant").isNotNull()
        phrase = F.when(kind.startswith("OBJECT"), named).when(pair, text(v, "$[0]")).otherwise(text(v, "$"))
        return F.struct(phrase.alias("phrase"), F.when(kind.startswith("OBJECT"), scored).when(pair, F.coalesce(number(v, "$[1]"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"))

    return F.filter(F.transform(F.try_variant_get(F.try_parse_json(x), "$", "array<variant>"), one), lambda c: c.phrase != "")


def q_candidate_coercion(spark, d):
    """Lists that mix objects of two kinds, pairs, strings, numbers and blanks, and broken ones."""
    e = table(spark, d, "events")
    n, t = (F.col("event_id") % 10).cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    j = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('[{"phrase":'), t, F.lit(',"score":'), n, F.lit('},{"phrase":" ","score":1},"x"]')))
    j = j.when(F.col("event_id") % 4 == 1, F.concat(F.lit('[{"candidate":'), t, F.lit(',"prior":'), n, F.lit('.5},["x",2],["x","no"]]')))
    j = j.when(F.col("event_id") % 4 == 2, F.concat(F.lit("[["), t, F.lit(","), n, F.lit('],"",7]'))).otherwise(F.concat(F.lit("["), t))
    c = e.select("event_id", F.explode(candidates(j)).alias("c"))
    return c.groupBy("c.phrase").agg(F.count("*").alias("n"), F.round(F.sum("c.score"), 4).alias("score"))


def q_candidate_rerank(spark, d):
    """Mined scores clipped to a prior, blended with a length-normalised stand-in for a model's score."""
    m = mined(spark, d)
    w = Window.partitionBy("qid")
    m = m.withColumn("clip", F.greatest(F.col("score"), F.lit(0.1)))
    m = m.withColumn("prior", F.log(F.col("clip") / F.sum("clip").over(w)))
    m = m.withColumn("final", F.round(-F.length("key") / F.sqrt(F.length("key").cast("double")) + 0.5 * F.col("prior"), 6))
    r = F.row_number().over(w.orderBy(F.desc("final"), "key"))
    return m.withColumn("rank", r).where("rank <= 3").select("qid", "rank", "key", "final")


def q_logit_diagnostics(spark, d):
    """Is the gold among the mined phrases, and is the best phrase the gold where it is; rates over the rows that have it."""
    m = mined(spark, d).groupBy("qid").agg(F.collect_set("key").alias("keys"), F.min(F.struct(-F.col("score"), "key")).alias("best"))
    gold = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.lower(F.regexp_extract(F.regexp_replace("text", r"[^\x00-\x7F]", "_"), r"^([A-Z][a-z]+)", 1)).alias("gold"))
    j = m.join(gold, "qid").select(F.array_contains("keys", F.col("gold")).cast("int").alias("mined"), (F.col("best.key") == F.col("gold")).cast("int").alias("selected"))
    return j.agg(F.count("*").alias("n"), F.round(F.avg("mined"), 6).alias("gold_mined"), F.round(F.coalesce(F.try_divide(F.sum(F.col("selected") * F.col("mined")), F.sum("mined")), F.lit(0.0)), 6).alias("selected_given_mined"))


def q_admission(spark, d):
    """Requests admitted by a service that takes at most 3 in any hour of one user: the rest find the queue full."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"))
    r = F.row_number().over(Window.partitionBy("user_id", "h").orderBy("ts", "event_id"))
    a = e.withColumn("r", r)
    return a.groupBy("user_id").agg(F.count_if(F.col("r") <= 3).alias("admitted"), F.count_if(F.col("r") > 3).alias("full"), F.max("r").alias("longest"))


def q_split_by_subject(spark, d):
    """Items split by the slug of their subject; rows without one are counted apart."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.concat_ws(" & ", "lang", "source")).alias("subject"))
    return docs.groupBy(slug(F.col("subject")).alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("subject").isNull()).alias("skipped"))


QUERIES = {
    "page_fetch": q_page_fetch, "page_search": q_page_search, "evidence_format": q_evidence_format, "replace_steps": q_replace_steps, "atomic_spans": q_atomic_spans, "candidate_coercion": q_candidate_coercion,
    "candidate_rerank": q_candidate_rerank, "logit_diagnostics": q_logit_diagnostics, "admission": q_admission, "split_by_subject": q_split_by_subject,
}
_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')
ORACLE_SQL = {
    "page_fetch": f"with k as (select url, any_value({_TEXT}) as t from pages group by url), u as (select page_id as req, unnest([url, url || '/missing']) as url from pages), f as (select req, u.url, coalesce(left(t, 8000), 'Error: page not found') as x from u left join k using (url)) select req, url, md5(x) as text_md5, length(x)::int as chars from f",
    "page_search": f"""with d as (select page_id as doc_id, {_TEXT} as text from pages), t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as term from d),
tf as (select doc_id, term, count(*) as tf from t group by all), dl as (select doc_id, sum(tf) as dl from tf group by all), df as (select term, count(*) as df from tf group by all), n as (select (select count(*) from d) as n, (select sum(dl) from dl) as total),
q as (select distinct item_id as qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) as term from benchmark),
h as (select qid, doc_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl * n / total))), 6) as score from q join df using (term) join tf using (term) join dl using (doc_id), n group by all)
select qid, row_number() over (partition by qid order by score desc, doc_id)::int as rank, doc_id, round(score, 4) as score from h qualify rank <= 5""",
    "evidence_format": _PASS + r""", cl as (select qid, rank, regexp_replace(title, '["\\\x00-\x1f]', ' ', 'g') as title, regexp_replace(body, '["\\\x00-\x1f]', ' ', 'g') as body from pa)
select qid, md5(string_agg('**Web Page ' || rank || ':**' || chr(10) || '{"title":"' || title || '","snippet":"' || left(body, 50) || '"}' || chr(10), chr(10) order by rank)) as evidence_md5 from cl group by qid""",
    "replace_steps": """with s as (select conv_id, turn, md5(text) as m from conversations where turn not in (1, 2, 99) union all select distinct conv_id, unnest([1, 99]), unnest(['edited', 'added']) from conversations)
select conv_id, count(*)::int as steps, string_agg(turn || '=' || m, ';' order by turn) as "all" from s group by conv_id""",
    "atomic_spans": rf"""with l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as n, ['number', 'date', 'person', 'location'][1 + doc_id % 4] as kind from (select doc_id, string_split(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), chr(10)) as x from documents)),
f as (select doc_id, n, line, trim(regexp_replace(line, '\s+', ' ', 'g')) as clean,
  list_filter(list_transform(case when kind in ('number', 'date') then regexp_extract_all(line, '{SPANS['number']}', 1) else [] end || case when kind = 'date' then regexp_extract_all(line, '{SPANS['year']}', 1) else [] end || case when kind in ('person', 'location') then regexp_extract_all(line, '{SPANS['name']}', 1) else [] end, lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: len(string_split(s, ' ')) <= {SPAN_WORDS}) as found from l),
a as (select doc_id, n, found || case when clean <> '' and len(string_split(clean, ' ')) <= {SPAN_WORDS} and not regexp_matches(clean, '[.!?;]|,.*,') then [clean] else [] end as spans from f),
u as (select doc_id, n, unnest(spans) as span, generate_subscripts(spans, 1) as pos from a), y as (select doc_id, n, arg_min(span, pos) as span from u group by doc_id, n, lower(span))
select doc_id, count(*) as spans, md5(string_agg(span, '|' order by span)) as spans_md5 from y group by doc_id""",
    "candidate_coercion": """with e as (select event_id, event_type, event_id % 10 as n, event_id % 4 as k from events), c as (
select event_type as phrase, case k when 1 then n + 0.5 else n end as score from e where k < 3 union all select 'x', 0 from e where k = 0 union all select 'x', 2 from e where k = 1 union all select 'x', 0 from e where k = 1 union all select '7', 0 from e where k = 2)
select phrase, count(*) as n, round(sum(score), 4)::double as score from c group by phrase""",
    "candidate_rerank": _MINED + ", c as (select qid, key, greatest(score, 0.1) as clip from mi), p as (select qid, key, ln(clip / sum(clip) over (partition by qid)) as prior from c), f as (select qid, key, round(-length(key) / sqrt(length(key)) + 0.5::double * prior, 6) as final from p) select qid, row_number() over (partition by qid order by final desc, key)::int as rank, key, final from f qualify rank <= 3",
    "logit_diagnostics": _MINED + r""", g as (select doc_id as qid, lower(regexp_extract(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '^([A-Z][a-z]+)', 1)) as gold from documents), b as (select qid, key from mi qualify row_number() over (partition by qid order by score desc, key) = 1),
j as (select exists (select 1 from mi where mi.qid = b.qid and mi.key = gold)::int as mined, (key = gold)::int as selected from b join g using (qid)) select count(*) as n, round(avg(mined), 6) as gold_mined, round(coalesce(sum(selected * mined) / nullif(sum(mined), 0)::double, 0.0), 6) as selected_given_mined from j""",
    "admission": "with r as (select user_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as r from events) select user_id, count(*) filter (r <= 3) as admitted, count(*) filter (r > 3) as \"full\", max(r)::int as longest from r group by 1",
    "split_by_subject": "with s as (select case when doc_id % 11 <> 0 then concat_ws(' & ', lang, source) end as subject from documents) select coalesce(nullif(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') as part, count(*) as n, count(*) filter (subject is null) as skipped from s group by 1",
}
