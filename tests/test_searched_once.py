"""What reads a search's result more than once stores it; long texts are cut or reduced before they are joined with it."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import prompts, vectors
from orrery.registry import QUERIES
from orrery.sources.scratch import Scratch

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "maps"), [("confidence_loop", 3), ("passages_or_error", 3), ("ivf_warmstart", 3 + 2), ("ivf_recall_vs_nprobe", 3 + 3)])
def test_exact_search_runs_once(spark, monkeypatch, name, maps):
    """An exact search is three maps: both sides packed, and the cells; a search of lists is one."""
    seen, stored = [], Scratch.stored

    def spied(self, df, name):
        seen.append(plan(df).count("MapInArrow run"))
        return stored(self, df, name)

    monkeypatch.setattr(Scratch, "stored", spied)
    result = QUERIES[name](spark, D)
    assert sum(seen) == maps and "MapInArrow" not in plan(result)


@pytest.mark.parametrize("name", ["overlap_jaccard_at_k", "rbo_at_k", "stability_by_bin_k"])
def test_lists_are_searched_before_the_join_reads_them(spark, monkeypatch, name):
    """The join counts, samples, orders and packs its vectors; none of these passes may run the search anew."""
    seen, stored = [], Scratch.stored

    def spied(self, df, name):
        seen.append((name, plan(df).count("MapInArrow run")))
        return stored(self, df, name)

    monkeypatch.setattr(Scratch, "stored", spied)
    QUERIES[name](spark, D)
    assert seen == [("lists", 3), ("blocks", 0), ("compared", 1)]


def test_texts_are_joined_last(spark):
    """After the join with the texts there is only the aggregation, which shuffles flags."""
    assert re.findall(r"Join Inner, \((\w+?)#", plan(QUERIES["retrieval_recall_precision"](spark, D)))[0] == "doc_id"


def test_passages_are_cut_before_the_join(spark):
    whole, cut = (prompts.passages(spark, D, body=x) for x in (None, 50))
    want = whole.withColumn("body", F.substring("body", 1, 50))
    assert sorted(map(str, cut.collect())) == sorted(map(str, want.collect()))
    assert plan(cut).index("Join Inner") < plan(cut).index(", 1, 50)")


def test_list_search_equals_brute_force(spark, monkeypatch):
    """A list in several pieces, its queries in several shares, equal scores; a label that nothing probes."""
    for name, v in (("BLOCK", 16), ("CELL_QUERIES", 60), ("CELL_CORPUS", 50)):
        monkeypatch.setattr(vectors, name, v)
    rng = np.random.default_rng(4)
    x, label = np.round(rng.normal(size=(300, 8)), 1), np.minimum(rng.integers(0, 6, 300), 3)
    x[7] = x[8] = x[9]
    e = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))] + [(900, None, 1), (901, [], 2)], "id long, v array<double>, label int")
    asked = {i: [c for c in (0, 2, 3) if (i + c) % 2] for i in range(300)}
    probe = spark.createDataFrame([(i, c) for i, cs in asked.items() for c in cs], "qid long, label int")
    want = set()
    for i, cs in asked.items():
        s = sorted((-round(float(x[i] @ x[j]), 9), j) for j in range(300) if j != i and label[j] in cs)[:5]
        want |= {(i, r + 1, j) for r, (_, j) in enumerate(s)}
    assert {tuple(r)[:3] for r in vectors.list_search(e, probe, 5).collect()} == want
