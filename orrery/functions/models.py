"""Where models plug in: generators, judges and complexity routers as protocols with deterministic stand-ins; no model is shipped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import judge_score
from orrery.sources.tables import table


@dataclass(frozen=True)
class Sampling:
    """What a generator is asked for; ``seed`` makes a stand-in's answers repeatable."""

    max_tokens: int = 64
    temperature: float = 0.0
    stop: tuple[str, ...] = ()
    seed: int = 0


@dataclass(frozen=True)
class Generated:
    text: str
    tokens_in: int
    tokens_out: int
    finish: str  # stop or length


class Generator(Protocol):
    """Prompts to answers, one batch at a time; a local model or a client of a service plugs in here."""

    def __call__(self, prompts: list[str], sampling: Sampling) -> list[Generated]: ...


class Judge(Protocol):
    """(question, answer) pairs to what the judge wrote; ``rating`` reads the number."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[str]: ...


class FirstWords:
    """Stand-in: answers with the prompt's last line, cut at a stop text and at the token limit."""

    def __call__(self, prompts: list[str], sampling: Sampling) -> list[Generated]:
        out = []
        for p in prompts:
            line = p.rstrip("\n").rpartition("\n")[2]
            cut = min((i for s in sampling.stop if (i := line.find(s)) >= 0), default=len(line))
            words = line[:cut].split()
            out.append(Generated(" ".join(words[: sampling.max_tokens]), len(p.split()), min(len(words), sampling.max_tokens), "length" if len(words) > sampling.max_tokens else "stop"))
        return out


class LengthJudge:
    """Stand-in: rates an answer by its words, 10 at most."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[str]:
        return [f"Rating: {min(10, len(a.split()))}" for _, a in pairs]


def max_tokens(params: dict, default: int = 64, new_first: bool = True) -> int:
    """One limit from its two usual names; with both given, ``new_first`` says which counts."""
    names = ("max_new_tokens", "max_tokens") if new_first else ("max_tokens", "max_new_tokens")
    return next((int(params[n]) for n in names if params.get(n) is not None), default)


def generated(rows: DataFrame, generator: Generator, key: str, prompt: str, sampling: Sampling = Sampling()) -> DataFrame:
    """(key, answer, tokens_in, tokens_out, finish): the generator over Arrow batches; null prompts as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = generator([p or "" for p in b.column(1).to_pylist()], sampling)
                columns = [[getattr(g, n) for g in found] for n in ("text", "tokens_in", "tokens_out", "finish")]
                types = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, "answer", "tokens_in", "tokens_out", "finish"])

    return rows.select(key, prompt).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, answer string, tokens_in long, tokens_out long, finish string")


def rated(rows: DataFrame, judge: Judge, key: str, question: str, answer: str) -> DataFrame:
    """(key, verdict, score): what the judge wrote, and the number after "Rating:" over 10, 0 if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                said = judge([(q or "", a or "") for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], [key, "verdict"])

    out = rows.select(key, question, answer).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, verdict string")
    return out.withColumn("score", judge_score(F.col("verdict"), "Rating:") / 10)


def log_probability(rows: DataFrame, corpus: DataFrame, key: str, text: str, of: str = "text") -> DataFrame:
    """(key, tokens, total, mean) of each text's words under add-one unigrams of the corpus; texts without words: no row."""
    split = lambda x: F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda w: w != "")
    counts = corpus.select(F.explode(split(F.col(of))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"))  # one row
    words = rows.select(key, F.explode(split(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("k"))
    scored = words.join(counts, "w", "left").join(F.broadcast(total), F.lit(True))
    scored = scored.withColumn("p", F.col("k") * F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("n") + F.col("v"))))
    return scored.groupBy(key).agg(F.sum("k").alias("tokens"), F.sum("p").alias("total")).withColumn("mean", F.col("total") / F.col("tokens"))


#: Classes of a question's complexity: no retrieval, one retrieval, several.
ROUTES = ("A", "B", "C")


def routed(question: Column) -> Column:
    """Rule-based stand-in for the three-way router: the class with the highest score, earlier classes on ties."""
    words = F.size(F.filter(F.split(question, " "), lambda w: w != ""))
    parts = F.size(F.split(question, "[,;]"))
    scores = F.array(F.lit(12.0) - words, F.lit(8.0) - F.abs(words - 16), words / 2.0 - 10 + parts)
    return F.element_at(F.array(*map(F.lit, ROUTES)), F.array_position(scores, F.array_max(scores)).cast("int"))


def q_generator_interface(spark, d):
    p = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("Answer this.\n"), F.regexp_replace("text", "[^A-Za-z., ]", " ")).alias("prompt"))
    return generated(p, FirstWords(), "id", "prompt", Sampling(max_tokens=12, stop=(". ",)))


def q_judge_interface(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.regexp_replace("text", "[^A-Za-z., ]", " ").alias("t"))
    r = rated(c, LengthJudge(), "id", "role", "t")
    return r.groupBy("score").agg(F.count("*").alias("n"))


def q_sequence_log_probability(spark, d):
    r = log_probability(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text")
    return r.select("item_id", "tokens", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def q_complexity_router(spark, d):
    first = F.element_at(F.split("text", "[.]"), 1)
    return table(spark, d, "conversations").select("role", routed(first).alias("route")).groupBy("role", "route").agg(F.count("*").alias("n"))


QUERIES = {"generator_interface": q_generator_interface, "judge_interface": q_judge_interface, "sequence_log_probability": q_sequence_log_probability, "complexity_router": q_complexity_router}
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
ORACLE_SQL = {
    "generator_interface": """with p as (select conv_id * 1000 + turn as id, regexp_replace(text, '[^A-Za-z., ]', ' ', 'g') as t from conversations),
w as (select id, list_filter(string_split(t, ' '), lambda x: x <> '') as all_words, list_filter(string_split(split_part(t, '. ', 1), ' '), lambda x: x <> '') as w from p)
select id, array_to_string(w[1:12], ' ') as answer, len(all_words) + 2 as tokens_in, least(len(w), 12) as tokens_out, case when len(w) > 12 then 'length' else 'stop' end as finish from w""",
    "judge_interface": "select least(10, len(list_filter(string_split(regexp_replace(text, '[^A-Za-z., ]', ' ', 'g'), ' '), lambda x: x <> ''))) / 10.0::double as score, count(*) as n from conversations group by 1",
    "sequence_log_probability": f"""with c as (select w, count(*) as c from (select unnest({_WORDS}) as w from documents) group by w), t as (select sum(c) as n, count(*) as v from c),
k as (select item_id, w, count(*) as k from (select item_id, unnest({_WORDS}) as w from benchmark) group by all),
p as (select item_id, k, k * ln((coalesce(c, 0) + 1) / (n + v)::double) as p from k left join c using (w) cross join t)
select item_id, sum(k)::bigint as tokens, round(sum(p), 4) as total, round(sum(p) / sum(k), 6) as mean from p group by item_id""",
    "complexity_router": """with q as (select role, split_part(text, '.', 1) as q from conversations), w as (select role, len(list_filter(string_split(q, ' '), lambda x: x <> '')) as w, len(regexp_split_to_array(q, '[,;]')) as parts from q),
s as (select role, 12.0::double - w as a, 8.0::double - abs(w - 16) as b, w / 2.0::double - 10 + parts as c from w)
select role, case when a >= b and a >= c then 'A' when b >= c then 'B' else 'C' end as route, count(*) as n from s group by all""",
}
