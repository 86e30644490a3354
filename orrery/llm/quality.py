"""Quality rules as a short-circuit cascade.

A rule has a test on a text's statistics. Its cost (seconds a document) and its selectivity (share of
documents that it rejects) are estimated on a bounded sample; the cascade then runs the rules by
rejection per cost and stops a document at the first rule that rejects it, so that what later rules would
count is never counted. The order changes the work, never the verdict: a document is kept if no rule rejects it.

``filtered`` runs one cascade of all rules and counts nothing beyond it. ``judged`` has to give five counts of
every document, which no order can save; there the cascade saves what is not given: the other rules' counts.

Null text: no words, so the base rule rejects it. Empty text: the same. Very long texts are read whole.
Repeated rows are judged each for itself; other columns pass through untouched; an empty table gives
an empty table.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from orrery.llm import common

#: Fixed values of the contract.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: The sample on which costs and selectivities are estimated: rows that may be in it, Arrow batches, rows of a batch. Only the order depends on it.
SAMPLE_SHARE, SAMPLE_SEED, SAMPLE_BATCHES, SAMPLE_ROWS = 0.25, 9, 4, 64


class Statistics:
    """The statistics of one text, each made when a rule first asks for it."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "replace").split()  # bytes.split() splits at the six ASCII spaces alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times, covered, end = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def n_loud_words(self) -> int:
        return len(re.findall(r"!!(?=[ \t\n\v\f\r]|\Z)", self.text))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is the test; ``sql`` says the same of the columns that the oracle has."""

    name: str
    rejects: Callable[[Statistics], bool]
    sql: str
    base: bool = False


#: Production rules. Whole-number arithmetic, so that every engine gets the same verdict.
RULES = (
    Rule("too_few_words", lambda s: s.n_words < 50, "n_words < 50", base=True),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 50 * s.n_words, "100 * n_repeat_words > 50 * n_words", base=True),
    Rule("symbols", lambda s: 10 * s.n_symbols > 3 * s.n_words, "10 * n_symbols > 3 * n_words"),
    Rule("word_length", lambda s: not 2 * s.n_words <= s.word_chars <= 20 * s.n_words, "not word_chars between 2 * n_words and 20 * n_words"),
    Rule("duplicate_lines", lambda s: 10 * s.n_dup_lines > 5 * len(s.lines), "10 * n_dup_lines > 5 * n_lines"),
    Rule("loud_words", lambda s: 10 * s.n_loud_words > 3 * s.n_words, "10 * n_loud_words > 3 * n_words"),
)


def ordered_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a document, share rejected), best rejection per cost first.

    The rules are tried where the rows are, on whole texts; a few numbers for each batch come to the driver,
    and no more partitions are read than these take.
    """
    common.text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sample = b.column(0)[:SAMPLE_ROWS].to_pylist()
            for k, rule in enumerate(rules):
                took, rejected = 0.0, 0
                for x in sample:
                    s = Statistics(x)
                    began = time.perf_counter()
                    rejected += rule.rejects(s)
                    took += time.perf_counter() - began
                yield pa.RecordBatch.from_pydict({"rule": pa.array([k], pa.int32()), "rows": [len(sample)], "rejected": [rejected], "took": [took]})

    tried = docs.select(F.col(text)).sample(False, SAMPLE_SHARE, SAMPLE_SEED).mapInArrow(run, "rule int, rows long, rejected long, took double")
    total = [[0, 0, 0.0] for _ in rules]
    for r in tried.limit(SAMPLE_BATCHES * len(rules)).collect():
        total[r["rule"]] = [a + b for a, b in zip(total[r["rule"]], (r["rows"], r["rejected"], r["took"]), strict=True)]
    found = [(rule, max(took / max(n, 1), 1e-9), rejected / max(n, 1)) for rule, (n, rejected, took) in zip(rules, total, strict=True)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def verdict(s: Statistics, rules: list[Rule]) -> str | None:
    """The name of the first rule in this order that rejects; None: kept."""
    for rule in rules:
        if rule.rejects(s):
            return rule.name
    return None


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, passing: tuple[str, ...] | None = None, name: str = "quality") -> DataFrame:
    """The columns ``passing`` (default: all) of every row and a struct column ``name`` with statistics and verdict.

    The struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept. These
    are counted whatever the verdict; the cascade spares a base-failed document the other rules, and a document
    the rules after the first that rejects.
    A column called ``name`` in the input is replaced.
    """
    order = [r for r, _, _ in ordered_rules(docs, text, rules)]
    base = [r for r in order if r.base]
    rest = [r for r in order if not r.base]
    keep = [c for c in (docs.columns if passing is None else passing) if c != name]
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, pa.int64()) for n in numbers] + [("base_failed", pa.bool_()), ("kept", pa.bool_())])
        for b in batches:
            out = []
            for x in b.column(0).to_pylist():
                s = Statistics(x)
                failed = verdict(s, base) is not None
                out.append({n: getattr(s, n) for n in numbers} | {"base_failed": failed, "kept": not failed and verdict(s, rest) is None})
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, kind)], [*b.schema.names[1:], name])

    found = StructType([StructField(n, LongType()) for n in numbers] + [StructField(n, BooleanType()) for n in ("base_failed", "kept")])
    schema = StructType([*docs.select(*keep).schema.fields, StructField(name, found)])
    return docs.select(F.col(text).alias("judged_text"), *keep).mapInArrow(run, schema)


def filtered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with their columns as they were: one cascade of all rules, stopped at the first that rejects."""
    order = [r for r, _, _ in ordered_rules(docs, text, rules)]
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([verdict(Statistics(x), order) is None for x in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_cascade(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return judged(docs, passing=("doc_id",)).select("doc_id", "quality.*")


def kept_sql() -> str:
    return " and ".join(f"not ({r.sql})" for r in RULES)


#: Statistics of every document, as the rules need them, in DuckDB.
STATISTICS_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (select rid, unnest(range(1, len(w) - 1)) as i, w from d where len(w) >= 3),
h as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n from g),
p as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from h where n > 1) group by rid),
s as (
  select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines,
         len(regexp_extract_all(t, '!!(?:[\x20\x09-\x0D]|\z)')) as n_loud_words,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join p using (rid))
"""

QUERIES = {"op9_quality_cascade": op9_quality_cascade}
ORACLE_SQL = {
    "op9_quality_cascade": STATISTICS_SQL + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {kept_sql()} as kept
from s"""
}
