"""Stored postings with block-max skipping: the same rows as an exhaustive score, most documents unscored; edge rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from orrery.operators import postings

D = "/root/testdata/sf0.1"
terms = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())


def scores(docs, query):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n, total, df = len(docs), sum(sum(c.values()) for _, c in tf), Counter(w for _, c in tf for w in c)
    out = []
    for i, c in tf:
        norm = 1.5 * (0.25 + 0.75 * sum(c.values()) * n / max(1, total))
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + norm) for w in set(terms(query)) if c[w])
        if s and i is not None:
            out.append((round(s, 6), i))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 24, 700])
def test_equals_exhaustive_scores(spark, tmp_path, shard_bytes):
    r = random.Random(4)
    words = ["The", "the", "a1", "river", "mill", "wheel", *(f"w{k}" for k in range(60))]
    docs = [(k, " ".join(r.choice(words[: 6 + k]) for _ in range(r.randint(1, 50)))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "é — 漢字"), *[(500 + k, "Tie, tie!") for k in range(8)], (600, "river " * 3000)]
    queries = [(1, "the river"), (2, "tie"), (3, None), (4, "nowhere"), (5, "w1 w2 w3 mill mill"), (6, " ".join(words))]
    path = f"{tmp_path}/p"
    postings.write_postings(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), path, shard_bytes)
    got = defaultdict(list)
    for q in postings.search_postings(spark, path, spark.createDataFrame(queries, "qid long, text string"), 5).orderBy("qid", "rank").collect():
        got[q["qid"]].append((q["score"], q["doc_id"]))
    for q, text in queries:
        want = [(round(s, 4), i) for s, i in sorted(scores(docs, text), key=lambda x: (-x[0], x[1]))[:5]]
        assert got[q] == [(pytest.approx(s), i) for s, i in want]
    assert [i for _, i in got[2]] == [500, 501, 502, 503, 504]
    assert (spark.read.parquet(f"{path}/postings").where("term is null").count() > 5) == (shard_bytes == 700)


def test_few_documents_are_scored():
    """Over sf0.1 and all queries in one shard: under a fifth of the pairs that share a word."""
    docs = pq.read_table(f"{D}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    queries = pq.read_table(f"{D}/benchmark.parquet").to_pylist()
    shard = postings.Shard(len(docs), sum(len(terms(d["text"])) for d in docs))
    for d in docs:
        shard.add(d["doc_id"], (d["text"] or "").lower().encode())
    head, *rows = shard.rows("x").to_pylist()
    found = postings.Searched(head["windows"], head["best"], shard.n, shard.total)
    lists = {r["term"]: (math.log(1 + (shard.n - r["df"] + 0.5) / (r["df"] + 0.5)), found.list_of(r)) for r in rows}
    pairs = 0
    for q in queries:
        own = [lists[w] for w in set(terms(q["text"])) if w in lists]
        found.search(own, 10)
        pairs += len({d for _, (windows, _, starts, places, _) in own for d in blocks_docs(windows, starts, places)})
    assert 0 < found.scored < 0.2 * pairs


def blocks_docs(windows, starts, places):
    import numpy as np

    return (np.repeat(windows, np.diff(np.append(starts, len(places)))) * postings.WINDOW + places).tolist()


def test_empty_tables(spark, tmp_path):
    docs, queries = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "qid long, text string")
    assert postings.bm25_stored(docs, queries, 5).count() == 0
    assert postings.bm25_stored(spark.createDataFrame([(1, "a")], "doc_id long, text string"), queries.limit(0), 5).count() == 0
