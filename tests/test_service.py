"""The three versions of the service on questions with and without passages and candidates; a model in place of the stand-ins."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import mining
from orrery.plans import service

HITS = [(1, 1, "T", "Old Mill stood by Old Mill River in 1888."), (1, 2, "U", "The wheel of Old Mill."), (2, 1, "u", "nothing here")]


def tables(spark):
    q = spark.createDataFrame([(1, " Which mill? "), (2, "what"), (3, "no passages")], "qid long, question string")
    return q, spark.createDataFrame(HITS, "qid long, rank int, title string, body string")


def test_versions(spark):
    q, hits = tables(spark)
    got = {(r.version, r.qid): r for r in service.served(q, hits).collect()}
    assert got.keys() == {("prompt", 1), ("prompt", 2), ("prompt", 3), ("stage1", 1), ("stage1_fallback", 2), ("stage1_fallback", 3), ("bias", 1), ("bias", 2), ("bias", 3)}
    assert got["prompt", 1].answer.endswith("Question: Which mill?") and "Old Mill River" in got["prompt", 1].answer
    assert got["stage1_fallback", 3].answer == "[answer] Question: no passages"
    assert got["stage1", 1].answer in ("1888", "Old Mill", "The") and got["stage1", 1].candidates >= 3
    assert got["bias", 1].biased > 0 and got["bias", 2].biased == got["bias", 2].candidates == 0


def test_biases_leave_out_what_a_better_one_holds(spark):
    _, hits = tables(spark)
    mined = mining.best(mining.merged(mining.mentions(hits)), 40)
    row = service.word_biases(mined).where("qid = 1").first()
    assert "mill" in row.biases and all(0 < b <= service.CAP for b in row.biases.values())
    keys = {r.key for r in mining.distinct_phrases(mined).collect()}
    assert not any(a != b and a in b for a in keys for b in keys if {"old mill", "old mill river"} >= {a, b}) or mined.where("key = 'old mill'").first().score > mined.where("key = 'old mill river'").first().score


def test_a_model_comes_in_as_a_udf(spark):
    q, hits = tables(spark)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return (x == "old mill river").astype(float) * 100

    mined = mining.best(mining.merged(mining.mentions(hits)), 40)
    assert {r.qid: r.answer for r in service.by_candidates(q, mined, score).collect()}[1] == "Old Mill River"


def test_blank_questions_raise(spark):
    q = spark.createDataFrame([(1, "  ")], "qid long, question string")
    with pytest.raises(Exception, match="non-empty"):
        service.by_prompt(q, tables(spark)[1]).collect()
