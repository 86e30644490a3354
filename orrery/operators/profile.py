"""What is in JSON lines: type histograms of every path, lengths and blanks, by Spark's VARIANT; no schema is given.

A line is parsed once into a variant. Each level below is one lateral ``variant_explode`` of the level above, so
objects and arrays are walked in the JVM, ``depth`` levels deep; what lies deeper counts with its parent only. One
aggregate of partial sums gives all paths. Elements of an array share the path ``a[]``.

Types: object, array, string, int, float, bool, null. Lengths are characters of strings, elements of arrays, keys of
objects. Blank lines and lines that are no JSON count in ``line_counts`` and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.tables import table

DEPTH = 4


def json_type(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null")
        .when(kind == "BIGINT", "int").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float").otherwise(F.lower(kind))
    )


def line_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """One row: lines, blank_lines, bad_lines."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return lines.agg(F.count("*").alias("lines"), F.count_if(blank).alias("blank_lines"), F.count_if(~blank & F.try_parse_json(text).isNull()).alias("bad_lines"))


def json_profile(lines: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(path, type, n, share, blank, min_len, avg_len, max_len); share: n by the number of good lines, so above 1 where a path repeats in a line."""
    spark = lines.sparkSession
    level = lines.where(F.trim(text) != "").select(F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).where("v is not null")
    every = level
    for _ in range(depth):
        below = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        level = below.select(F.concat("path", F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), "key"))).alias("path"), F.col("value").alias("v"))
        every = every.union(level)
    typed = every.select("path", json_type(F.col("v")).alias("type"), "v")
    said = F.when(F.col("type") == "string", F.try_variant_get("v", "$", "string"))
    size = F.coalesce(F.char_length(said), F.when(F.col("type") == "array", F.size(F.try_variant_get("v", "$", "array<variant>"))), F.when(F.col("type") == "object", F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))))
    each = typed.select("path", "type", size.alias("size"), (F.trim(said) == "").alias("blank"))
    found = each.groupBy("path", "type").agg(F.count("*").alias("n"), F.count_if("blank").alias("blank"), F.min("size").alias("min_len"), F.round(F.avg("size"), 4).alias("avg_len"), F.max("size").alias("max_len"))
    good = lines.agg(F.count_if((F.trim(text) != "") & F.try_parse_json(text).isNotNull()).alias("good"))
    return found.join(F.broadcast(good)).select("path", "type", "n", F.round(F.col("n") / F.col("good"), 6).alias("share"), "blank", "min_len", "avg_len", "max_len")


def q_json_types(spark, d):
    """Of the events, with their JSON properties inside another object; every seventh line is broken."""
    e = table(spark, d, "events")
    kind = F.when(F.col("user_id") % 3 == 0, F.lit("null")).when(F.col("user_id") % 3 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(F.lit('" "'))
    text = F.concat(F.lit('{"props":'), "props", F.lit(',"kind":'), kind, F.lit(',"pair":['), F.col("user_id").cast("string"), F.lit(',{"odd":'), F.when(F.col("event_id") % 2 == 1, "true").otherwise("1.5"), F.lit("}]"), F.when(F.col("event_id") % 7 == 6, "").otherwise("}"))
    return json_profile(e.select(text.alias("text")))


QUERIES = {"json_types": q_json_types}
ORACLE_SQL = {
    "json_types": """with l as (select '{"props":' || props || ',"kind":' || case user_id % 3 when 0 then 'null' when 1 then '"' || event_type || '"' else '" "' end || ',"pair":[' || user_id || ',{"odd":' || case when event_id % 2 = 1 then 'true' else '1.5' end || '}]' || case when event_id % 7 = 6 then '' else '}' end as j from events),
g as (select j::json as j from l where json_valid(j)),
t as (select regexp_replace(fullkey, '\\[\\d+\\]', '[]', 'g') as path, t.type as kind, t.value as value from g, json_tree(g.j) as t),
y as (select path, case when kind = 'OBJECT' then 'object' when kind = 'ARRAY' then 'array' when kind = 'VARCHAR' then 'string' when kind = 'BOOLEAN' then 'bool' when kind = 'NULL' then 'null' when kind = 'DOUBLE' then 'float' else 'int' end as type,
        case when kind = 'VARCHAR' then length(value ->> '$') when kind = 'ARRAY' then json_array_length(value)::bigint when kind = 'OBJECT' then len(json_keys(value)) end as size, kind = 'VARCHAR' and trim(value ->> '$') = '' as blank from t)
select path, type, count(*) as n, round(count(*) / (select count(*) from g)::double, 6) as share, count(*) filter (blank) as blank, min(size)::int as min_len, round(avg(size), 4) as avg_len, max(size)::int as max_len from y group by all""",
}
