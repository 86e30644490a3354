"""Ranked search against brute force: ties, repeats, nulls, many shards and blocks; the code of postings; pruning."""

import math
import random
import re
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import common, search
from test_llm_operators import DOCS, edge_docs, empty_docs, prose

ITEMS = "item_id long, text string"


def terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]


def brute(docs, items, k=10):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    big, total, df = len(tfs), sum(sum(c.values()) for _, c in tfs), Counter(w for _, c in tfs for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in tfs:
            m = 25 + (75 * sum(c.values()) * big) // total
            s = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **kw):
    with common.small_batches(spark):
        shards = common.stored(search.index(docs, **kw), "shards")
        return sorted(map(tuple, search.search(shards, items).collect()), key=repr)


@pytest.mark.parametrize("shard_bytes", [2000, 1 << 24])
def test_equals_brute_force(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    r = random.Random(3)
    more = [(100 + k, " ".join(r.choice(["Alpha", "beta", "éa", "x1", "THE", "the", "rare%d" % (k % 7), "漢字"]) for _ in range(r.randint(1, 60))), None, None, 0) for k in range(160)]
    more += [(50 + k, "tie TIE-tie", None, None, 0) for k in range(14)] + [(900, "the, the; éa_x1", "en", None, 0)] * 2
    docs = edge_docs(spark, *more).repartition(3)
    items = [(1, "the alpha rare3 rare3"), (2, "tie"), (3, None), (4, ""), (5, "nowhere"), (None, "beta éa"), (6, "x1 漢字"), (6, "rare1"), (6, "rare1"), (7, prose(5, 30)), (8, "the " * 50 + "ALPHA"), (9, prose(6, 3))]
    want = brute([(x["doc_id"], x["text"]) for x in docs.collect()], items)
    assert [x[2] for x in sorted((w for w in want if w[0] == 2), key=lambda w: w[1])] == list(range(50, 60))
    got = found(spark, docs, spark.createDataFrame(items, ITEMS), shard_bytes=shard_bytes)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    alike = Counter(w[0::3] for w in want)  # rows that share id and score may stand in either order
    assert [g for g in got if alike[g[0::3]] == 1] == [w for w in want if alike[w[0::3]] == 1]


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert found(spark, empty_docs(spark), items) == []
    assert found(spark, spark.createDataFrame([(1, "a", None, None, 0)], DOCS), items.limit(0)) == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string").withColumns({"term": F.lit(1), "N": F.lit(2), "shard": F.lit("x")})
    items = spark.createDataFrame([(1, "a")], ITEMS).withColumns({"query": F.lit(1), "block": F.lit(2), "id": F.lit(3)})
    assert [g[:3] for g in found(spark, docs, items)] == [(1, 1, 1)]


def test_variable_bytes():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**55], np.int64)
    code, size = search.packed(v)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 5, 8] and search.unpacked(code.tobytes()).tolist() == v.tolist()
    assert search.unpacked(b"").tolist() == []


def test_lists_that_cannot_win_leave_the_heap():
    """A common term is looked up for few of its documents once the heap is full."""

    class Counted(array):
        read = 0

        def __getitem__(self, i):
            Counted.read += 1
            return array.__getitem__(self, i)

    def postings(docs, score):
        p = object.__new__(search.Postings)
        p.docs, p.scores, p.top = array("q", docs), Counted("q", [score] * len(docs)), score
        return p

    r = random.Random(1)
    rare = sorted(r.sample(range(20_000), 40))
    lists = [(postings(range(20_000), 5), 1), (postings(rare, 1000), 1)]
    assert search.best_of(lists, 10) and sorted(-d for _, d in search.best_of(lists, 10)) == rare[:10]
    assert Counted.read < 2 * (rare[9] + 2 * len(rare) + 20)
