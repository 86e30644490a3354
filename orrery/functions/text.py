"""Scalar text functions as Column expressions: all run in the JVM, inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.tables import table

#: The 32 ASCII punctuation characters, articles, chat roles.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
ROLE_MARK = r"(?im)^\s*(system|user|assistant)\s*:\s*"
#: How a question opens, and the type of its answer; the first that fits counts.
ANSWER_TYPES = (
    ("person", ("who ", "whose ")),
    ("number", ("how many ", "how much ")),
    ("date", ("when ", "what year ", "what month ", "what date ")),
    ("location", ("where ", "what city ", "what country ", "what state ")),
)
#: Stop list of tokens.
JUNK_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "was", "for", "on", "with", "as", "by")
#: Words that are no candidate phrase.
SPAN_STOPS = ("the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "by", "with", "is", "was", "it", "this", "that")
#: Literal replacements from web to knowledge-base wording, in this order.
WORDING = (
    ("web search", "knowledge base retrieval"),
    ("Web search", "Knowledge base retrieval"),
    ("search the web", "retrieve from the knowledge base"),
    ("Search the web", "Retrieve from the knowledge base"),
    ("search engine", "retriever"),
    ("webpage", "retrieved passage"),
    ("web page", "retrieved passage"),
    ("web pages", "retrieved passages"),
    ("search results", "retrieval results"),
    ("Bing", "the retriever"),
    ("browser", "retriever"),
    ("online", "in the knowledge base"),
    ("internet", "knowledge base"),
    ("web", "knowledge base"),
)


def words(x: Column) -> Column:
    """Tokens between white space (Unicode), without empty ones."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def normalize_answer(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces. Null stays null."""
    bare = F.regexp_replace(F.lower(x), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(bare, r"(?U)\s+"), lambda t: ~t.isin("", *ARTICLES)), " ")


def remove_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, PUNCTUATION, "")


def slug(x: Column) -> Column:
    """Lower case, other than a-z and 0-9 as single underscores, none at the ends; empty or null: unknown."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def dataset_name(path: Column) -> Column:
    """File name of a path without .jsonl, unsafe characters as underscores."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?i)\\.jsonl$", "")
    return F.regexp_replace(base, "[^A-Za-z0-9._-]+", "_")


def short_answer(x: Column, cap: int = 80) -> Column:
    """First line up to its first full stop, without quotes around it, at most ``cap`` characters."""
    first = F.substring_index(F.substring_index(F.trim(x), "\n", 1), ".", 1)
    return F.substring(F.trim(F.regexp_replace(F.trim(first), "^[\"']+|[\"']+$", "")), 1, cap)


def normalize_question(x: Column) -> Column:
    """Trimmed, first letter lower, one question mark at the end; blank: a lone mark."""
    q = F.trim(F.coalesce(x, F.lit("")))
    marked = F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?")))
    return F.concat(F.lower(F.substring(marked, 1, 1)), F.substring(marked, 2, 1_000_000_000))


def sanitize_passage(x: Column) -> Column:
    """Without NULs and without role markers at line starts."""
    return F.regexp_replace(F.replace(x, F.lit("\x00"), F.lit("")), ROLE_MARK, "")


def answer_type(q: Column) -> Column:
    low = F.lower(F.trim(q))
    out = F.lit("other")
    for kind, heads in reversed(ANSWER_TYPES):
        out = F.when(reduce(lambda a, b: a | b, (F.startswith(low, F.lit(h)) for h in heads)), F.lit(kind)).otherwise(out)
    return out


def clean_span(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^[ .,;:!?\"'()\\[\\]]+|[ .,;:!?\"'()\\[\\]]+$", "")


def plausible_span(x: Column) -> Column:
    """At most 8 words and 80 characters, not a stop word, no sentence marks, under two commas, enough letters and digits."""
    alnum = F.length(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    return (
        (F.size(F.split(x, " ")) <= 8)
        & (F.length(x) <= 80)
        & ~F.lower(x).isin(*SPAN_STOPS)
        & ~F.regexp_like(x, F.lit("[.!?;]"))
        & (F.length(x) - F.length(F.replace(x, F.lit(","), F.lit(""))) < 2)
        & (alnum >= F.greatest(F.lit(2), F.floor(F.length(x) * 0.4)))
    )


def approximate_tokens(x: Column) -> Column:
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(x) / 4))).cast("long")


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.2f TB", n / float(1 << 40))
    for unit, size in (("GB", 1 << 40), ("MB", 1 << 30), ("KB", 1 << 20), ("B", 1 << 10)):
        out = F.when(n < size, F.format_string(f"%.2f {unit}", n / float(size >> 10))).otherwise(out)
    return out


def count_token(n: Column) -> Column:
    """1000 as 1K, 2000000 as 2M, 3000000000 as 3B; other numbers as they are."""
    out = n.cast("string")
    for unit, size in (("K", 1000), ("M", 1_000_000), ("B", 1_000_000_000)):
        out = F.when((n >= size) & (n % size == 0), F.concat((n / size).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


def between_or_to_end(x: Column, start: str, end: str) -> Column:
    """After the last ``start`` up to ``end``, or to the end of the text; null without ``start``."""
    return F.when(F.contains(x, F.lit(start)), F.trim(F.substring_index(F.substring_index(x, start, -1), end, 1)))


def last_match(x: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def first_line(x: Column) -> Column:
    return F.regexp_replace(F.substring_index(x, "\n", 1), "^\"|\"$", "")


def rest_of_lines(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("\n")), F.substring(x, F.locate("\n", x) + 1, F.length(x))).otherwise(F.lit(""))


def corpus_wording(x: Column) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), WORDING, x)


def cut_at_stops(x: Column, stops: tuple[str, ...]) -> Column:
    """The text before the earliest stop string."""
    found = [F.nullif(F.locate(s, x), F.lit(0)) for s in stops]
    least = F.least(*found) if len(found) > 1 else found[0]
    return F.when(least.isNotNull(), F.substring(x, F.lit(1), least - 1)).otherwise(x)


def judge_score(x: Column, marker: str) -> Column:
    """The first number after the marker, else 0."""
    tail = F.when(F.contains(x, F.lit(marker)), F.substring_index(x, marker, -1)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(tail, r"(\d+)", 1).try_cast("double"), F.lit(0.0))


def has_han(x: Column) -> Column:
    return F.regexp_like(x, F.lit(r"[\x{4E00}-\x{9FFF}]"))


def sentences(x: Column) -> Column:
    """Pieces after . ! or ? and white space."""
    return F.split(x, r"(?<=[.!?])\s+")


def junk_token(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return (F.length(low) < 2) | F.regexp_like(low, F.lit(r"^[\W_]+$")) | F.regexp_like(low, F.lit(r"^\d+$")) | low.isin(*JUNK_WORDS)


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def q_normalize_answer(spark, d):
    n = normalize_answer(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_len"))


def q_short_answer(spark, d):
    return _docs(spark, d).select("doc_id", short_answer(F.col("text")).alias("answer"), approximate_tokens(F.col("text")).alias("approx_tokens"))


def q_slug_sources(spark, d):
    return _docs(spark, d).groupBy(slug(F.concat_ws(" / ", F.col("source"), F.col("lang"))).alias("slug")).agg(F.count("*").alias("n"))


def q_dataset_name(spark, d):
    return table(spark, d, "pages").select("page_id", dataset_name(F.concat(F.col("url"), F.lit(".JSONL"))).alias("dataset"))


def q_normalize_question(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", normalize_question(F.col("text")).alias("question"), answer_type(F.concat(F.lit("Who "), F.col("text"))).alias("who_type"), answer_type(F.col("text")).alias("answer_type"))


def q_sanitize_passage(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", sanitize_passage(F.concat(F.lit("  User: "), F.col("text"))).alias("clean"))


def q_span_gates(spark, d):
    s = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"[\n.]")).alias("pos", "piece"))
    s = s.select("doc_id", "pos", clean_span(F.col("piece")).alias("span")).where(F.length("span") > 0)
    return s.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count_if(plausible_span(F.col("span"))).alias("plausible"))


def q_human_sizes(spark, d):
    n = F.col("n_chars") * F.lit(1000)
    return _docs(spark, d).select("doc_id", human_bytes(n.cast("double")).alias("size"), count_token(n).alias("count"))


def q_extract_between(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", between_or_to_end(F.col("html"), "<h1>", "</h1>").alias("heading"), last_match(F.col("html"), r"<title>([^<]*)</title>").alias("title"), between_or_to_end(F.col("html"), "<nothing>", "x").alias("none"))


def q_title_body(spark, d):
    return _docs(spark, d).select("doc_id", first_line(F.col("text")).alias("title"), F.md5(rest_of_lines(F.col("text"))).alias("body_md5"))


def q_wording_and_stops(spark, d):
    t = F.concat(F.lit("search the web page "), F.col("text"))
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", corpus_wording(t).alias("wording"), cut_at_stops(F.col("text"), (". ", "\n", "?")).alias("cut"))


def q_judge_score(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", judge_score(F.concat(F.lit("Rating: ["), F.col("turn").cast("string"), F.lit("]")), "Rating:").alias("score"), has_han(F.col("text")).alias("han"))


def q_sentence_split(spark, d):
    s = sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).alias("sentences"), F.md5(F.element_at(s, -1)).alias("last_md5"))


def q_junk_tokens(spark, d):
    t = _docs(spark, d).select(F.explode(words(F.col("text"))).alias("token"))
    return t.groupBy(junk_token(F.col("token")).alias("junk")).agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("kinds"))


QUERIES = {
    "normalize_answer": q_normalize_answer,
    "short_answer": q_short_answer,
    "slug_sources": q_slug_sources,
    "dataset_name": q_dataset_name,
    "normalize_question": q_normalize_question,
    "sanitize_passage": q_sanitize_passage,
    "span_gates": q_span_gates,
    "human_sizes": q_human_sizes,
    "extract_between": q_extract_between,
    "title_body": q_title_body,
    "wording_and_stops": q_wording_and_stops,
    "judge_score": q_judge_score,
    "sentence_split": q_sentence_split,
    "junk_tokens": q_junk_tokens,
}

_NORM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda t: t not in ('', 'a', 'an', 'the')), ' ')"
_TYPE = """case when starts_with(q, 'who ') or starts_with(q, 'whose ') then 'person' when starts_with(q, 'how many ') or starts_with(q, 'how much ') then 'number'
  when starts_with(q, 'when ') or starts_with(q, 'what year ') or starts_with(q, 'what month ') or starts_with(q, 'what date ') then 'date'
  when starts_with(q, 'where ') or starts_with(q, 'what city ') or starts_with(q, 'what country ') or starts_with(q, 'what state ') then 'location' else 'other' end"""
_WORDED = reduce(lambda x, r: f"replace({x}, '{r[0]}', '{r[1]}')", WORDING, "x")

ORACLE_SQL = {
    "normalize_answer": f"select doc_id, md5(n) as norm_md5, length(n)::int as norm_len from (select doc_id, {_NORM} as n from documents)",
    "short_answer": r"""select doc_id, left(trim(regexp_replace(trim(split_part(split_part(trim(text), chr(10), 1), '.', 1)), '^["'']+|["'']+$', '', 'g')), 80) as answer,
  case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end::bigint as approx_tokens from documents""",
    "slug_sources": "select coalesce(nullif(regexp_replace(regexp_replace(lower(concat_ws(' / ', source, lang)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') as slug, count(*) as n from documents group by 1",
    "dataset_name": r"select page_id, regexp_replace(regexp_replace(list_extract(string_split(url || '.JSONL', '/'), -1), '(?i)\.jsonl$', ''), '[^A-Za-z0-9._-]+', '_', 'g') as dataset from pages",
    "normalize_question": f"""with t as (select item_id, trim(text) as x from benchmark), m as (select *, case when ends_with(x, '?') then x else x || '?' end as y, lower(x) as q from t)
select item_id, lower(left(y, 1)) || substr(y, 2) as question, 'person' as who_type, {_TYPE} as answer_type from m""",
    "sanitize_passage": r"select conv_id, turn, regexp_replace(replace('  User: ' || text, chr(0), ''), '(?im)^\s*(system|user|assistant)\s*:\s*', '', 'g') as clean from conversations",
    "span_gates": r"""with p as (select doc_id, unnest(regexp_split_to_array(text, '[\n.]')) as piece from documents),
s as (select doc_id, regexp_replace(trim(regexp_replace(piece, '\s+', ' ', 'g')), '^[ .,;:!?"''()\[\]]+|[ .,;:!?"''()\[\]]+$', '', 'g') as span from p)
select doc_id, count(*) as spans, count(*) filter (len(string_split(span, ' ')) <= 8 and length(span) <= 80
  and lower(span) not in ('the','a','an','of','and','or','to','in','on','for','by','with','is','was','it','this','that') and not regexp_matches(span, '[.!?;]')
  and length(span) - length(replace(span, ',', '')) < 2 and length(regexp_replace(span, '[^A-Za-z0-9]', '', 'g')) >= greatest(2, floor(length(span) * 0.4))) as plausible
from s where length(span) > 0 group by doc_id""",
    "human_sizes": """with t as (select doc_id, n_chars * 1000 as n from documents)
select doc_id, case when n < 1024 then format('{:.2f} B', round(n::double, 2)) when n < 1048576 then format('{:.2f} KB', round(n / 1024.0::double, 2)) when n < 1073741824 then format('{:.2f} MB', round(n / 1048576.0::double, 2)) else format('{:.2f} GB', round(n / 1073741824.0::double, 2)) end as size,
  case when n >= 1000000000 and n % 1000000000 = 0 then (n // 1000000000)::varchar || 'B' when n >= 1000000 and n % 1000000 = 0 then (n // 1000000)::varchar || 'M' when n >= 1000 and n % 1000 = 0 then (n // 1000)::varchar || 'K' else n::varchar end as count from t""",
    "extract_between": r"""select page_id, case when contains(html, '<h1>') then trim(split_part(list_extract(string_split(html, '<h1>'), -1), '</h1>', 1)) end as heading,
  list_extract(regexp_extract_all(html, '<title>([^<]*)</title>', 1), -1) as title, null::varchar as "none" from pages""",
    "title_body": """select doc_id, regexp_replace(split_part(text, chr(10), 1), '^"|"$', '', 'g') as title,
  md5(case when contains(text, chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end) as body_md5 from documents""",
    "wording_and_stops": """with t as (select conv_id, turn, 'search the web page ' || text as x, text, list_filter([instr(text, '. '), instr(text, chr(10)), instr(text, '?')], lambda i: i > 0) as stops from conversations)
select conv_id, turn, {_WORDED} as wording,
  case when len(stops) > 0 then left(text, list_min(stops) - 1) else text end as cut from t""".replace("{_WORDED}", _WORDED),
    "judge_score": r"select conv_id, turn, turn::double as score, regexp_matches(text, '[\x{4E00}-\x{9FFF}]') as han from conversations",
    "sentence_split": r"""with t as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) as s from documents)
select doc_id, len(s)::int as sentences, md5(s[-1]) as last_md5 from t""",
    "junk_tokens": r"""with t as (select unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) as token from documents)
select length(trim(token)) < 2 or regexp_matches(lower(token), '^[^0-9A-Za-z_]+$') or lower(token) similar to '_+' or regexp_matches(token, '^\d+$') or lower(token) in ('the','a','an','and','or','of','to','in','is','was','for','on','with','as','by') as junk,
  count(*) as tokens, count(distinct token) as kinds from t group by 1""",
}
