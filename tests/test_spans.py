"""Atomic spans by kind of question, candidates in any encoding, run folders."""

from pyspark.sql import functions as F

from orrery.operators import agents
from orrery.sources import readers


def test_spans_by_kind(spark):
    rows = [
        (1, "He wrote 12 pages and 3.5 Miles by Vincent van Gogh and J. Doe in 1888.", "number"), (2, "He wrote 12 pages by Vincent van Gogh in 1888.", "person"), (3, "in 1888, not 1234", "date"),
        (4, "New York", "location"), (5, "new york", "other"), (6, "", "date"), (7, None, "date"),
    ]
    df = spark.createDataFrame(rows, "id long, x string, kind string")
    got = {r.id: r.s for r in df.select("id", agents.atomic_spans(F.col("x"), F.col("kind")).alias("s")).collect()}
    assert got[1] == ["12 pages", "3.5 Miles", "1888"] and got[2] == ["He", "Vincent van Gogh"]
    assert got[3] == ["1888", "1234", "1888", "in 1888, not 1234"] and got[4] == ["New York", "New York"] and got[5] == ["new york"]
    assert got[6] == [] and not got[7]


def test_spans_once_whatever_their_case(spark):
    df = spark.createDataFrame([(1, ["New York", "new york", "1888"]), (1, ["NEW YORK"]), (2, [])], "id long, spans array<string>")
    got = sorted(map(tuple, agents.distinct_spans(df.where("size(spans) > 1 or id = 2"), "id").collect()))
    assert got == [(1, "1888"), (1, "New York")]


def test_candidates_in_any_encoding(spark):
    j = '[{"phrase":" a ","score":1},{"candidate":"b","phrase":"x","llm_score":"2.5"},{"candidate":"","phrase":"c","prior":3},["d",4],["e","no"],["f",null],"g",7,true," ",null,{"score":9},["h"]]'
    df = spark.createDataFrame([(1, j), (2, "[broken"), (3, None), (4, "{}"), (5, "[]")], "id long, x string")
    got = {r.id: r.c and [tuple(c) for c in r.c] for r in df.select("id", agents.candidates(F.col("x")).alias("c")).collect()}
    assert got[1][:9] == [("a", 1.0), ("b", 2.5), ("c", 3.0), ("d", 4.0), ("e", 0.0), ("f", 0.0), ("g", 0.0), ("7", 0.0), ("true", 0.0)]
    assert not got[2] and not got[3] and not got[4] and got[5] == []


def test_run_folders_once(spark, tmp_path):
    for f in ("b/one/results.jsonl", "b/one/results_2.jsonl", "a/two/results.jsonl", "a/two/other.jsonl", "a/results.jsonl"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("{}\n")
    got = [(r.run, r.files, r.bytes) for r in readers.discover_runs(spark, f"{tmp_path}").collect()]
    assert got == [("a", 1, 3), ("two", 1, 3), ("one", 2, 6)]
