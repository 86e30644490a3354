"""Candidates: dates, keys and their longest forms, and phrases inside better ones; stages beyond the preferred."""

import random
from collections import defaultdict


from orrery.operators import mining, traces

ROWS = "qid long, rank int, title string, body string"


def test_mentions(spark):
    rows = [(1, 1, "The Old Mill.", "In March 12, 1999 and jan 3 it was 12345. A of"), (1, 2, None, "Old  Mill\nRiver in 1999."), (2, 1, "é May 4 é", None)]
    got = defaultdict(list)
    for r in mining.mentions(spark.createDataFrame(rows, ROWS)).collect():
        got[r.qid, r.phrase].append(round(r.score, 6))
    assert got[1, "March 12, 1999"] == [1.0] and got[1, "jan 3"] == [1.0] and got[2, "May 4"] == [1.0]
    assert sorted(got[1, "1999"]) == [0.25, 0.5, 0.5, 1.0]  # number and year, in the first passage and the second
    assert got[1, "The Old Mill"] == [1.0] and got[1, "Old  Mill\nRiver"] == [0.5]
    assert not {(1, "A"), (1, "12345"), (1, "In")} & got.keys()


def test_merged_by_key_keeps_the_longest_form(spark):
    c = [(1, "old mill", 1.0), (1, "Old  Mill.", 0.5), (1, "OLD MILL", 0.25), (1, "a b c d e f g", 1.0), (1, "A b c d e f g!!", 1.0), (1, "(a b  c d e f g)", 1.0), (1, "...", 9.0), (2, "old mill", 1.0)]
    got = {(r.qid, r.key): (r.phrase, r.score) for r in mining.merged(spark.createDataFrame(c, "qid long, phrase string, score double")).collect()}
    assert got[1, "old mill"] == ("Old  Mill.", 1.75) and got[2, "old mill"] == ("old mill", 1.0)
    assert got[1, "a b c d e f g"] == ("(a b  c d e f g)", 2.0) and (1, "") not in got
    assert len(got) == 4  # "a b c d e f g!!" keeps its marks: they are no edge that goes


def test_phrases_inside_better_ones_go(spark):
    r = random.Random(8)
    rows = {(q, k): round(r.random(), 1) for q in range(30) for k in {" ".join(r.choice("ab c d aa".split()) for _ in range(r.randint(1, 4))) for _ in range(25)}}
    want = set()
    for q in range(30):
        kept = []
        for s, n, k in sorted((-s, -len(k), k) for (x, k), s in rows.items() if x == q):
            if not any(k in b for b in kept):
                kept.append(k)
        want |= {(q, k) for k in kept}
    df = spark.createDataFrame([(q, k, s) for (q, k), s in rows.items()], "qid long, key string, score double").repartition(5)
    assert {(x.qid, x.key) for x in mining.distinct_phrases(df).collect()} == want
    short = spark.createDataFrame([(1, "york", 0.9), (1, "new york", 0.5)], "qid long, key string, score double")
    assert mining.distinct_phrases(short).count() == 2  # the better score comes first, though shorter


def test_stages_beyond_the_preferred_come_last(spark):
    t = spark.createDataFrame([(1, "view", 1.0), (1, "b stage", 2.0), (2, "a.stage", 3.0), (2, "view", 0.5)], "run long, stage string, latency double")
    out = traces.stage_columns(t, ("click", "view"))
    assert out.columns == ["run", "view", "a.stage", "b stage"]
    assert sorted(map(tuple, out.collect())) == [(1, 1.0, 0.0, 2.0), (2, 0.5, 3.0, 0.0)]
