"""Near copies amid a line, and the whole result against brute force: every pair of paragraphs, every repeated window."""

import random
from collections import defaultdict

import numpy as np
import pytest

from orrery.llm import paragraphs

VOCABULARY = [f"w{k}" for k in range(4000)]


def sentences(r, n):
    out = []
    while n > 0:
        k = min(n, r.randint(6, 16))
        out.append(" ".join(r.choice(VOCABULARY) for _ in range(k)) + ".")
        n -= k
    return " ".join(out)


def edited(r, passage):
    """One word in 45 changed."""
    words = passage.split(" ")
    for k in range(len(words) // 45):
        at = 45 * k + r.randint(0, 44)
        words[at] = f"x{r.randint(0, 9999)}" + ("." if words[at].endswith(".") else "")
    return " ".join(words)


def words_of(*texts):
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return paragraphs.Words(np.concatenate(data), np.append(0, np.cumsum([len(d) for d in data])))


def sets_of(*texts):
    """Of each text its paragraphs as (start, end, words, shingles)."""
    w = words_of(*texts)
    offset = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    a, e = paragraphs.paragraphs_of(w)
    sh = paragraphs.shingles(w)
    out = defaultdict(list)
    for x, y in zip(a.tolist(), e.tolist(), strict=True):
        t = int(w.text[x])
        out[t].append((int(w.start[x] - offset[t]), int(w.end[y - 1] - offset[t]), y - x, frozenset(sh[x : y - paragraphs.SHINGLE + 1].tolist())))
    return out


def like(x, y):
    return len(x & y) >= paragraphs.SIMILARITY * len(x | y)


@pytest.mark.parametrize("n", [60, 90, 150, 300])
def test_near_copies_amid_a_line(n):
    """Between other sentences of one line in both texts; at least nine in ten give a pair of paragraphs."""
    r, found = random.Random(n), 0
    for _ in range(200):
        passage = sentences(r, n)
        around = lambda p: f"{sentences(r, r.randint(20, 120))} {p} {sentences(r, r.randint(20, 120))}"
        sets = sets_of(around(passage), around(edited(r, passage)))
        found += any(like(x[3], y[3]) for x in sets[0] for y in sets[1])
    assert found >= 180


def test_repeats_equal_brute_force(spark):
    """Completeness: every paragraph of a cluster over several documents has its row and its cluster's smallest id. Soundness: every other row is a run of repeated windows."""
    r = random.Random(12)
    passages = [sentences(r, n) for n in (55, 70, 90, 120, 160, 52)]
    texts = {}
    for doc in range(40):
        parts = [sentences(r, r.randint(5, 70)) for _ in range(r.randint(1, 4))]
        for p in r.sample(passages, r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), edited(r, p) if r.random() < 0.6 else p)
        texts[doc] = r.choice([" ", "\n"]).join(parts)
    sets = sets_of(*texts.values())
    nodes = [(d, *p) for d in texts for p in sets[d]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[i + 1 :]:
            if x[4] == y[4] or (x[0] != y[0] and like(x[4], y[4])):
                root[find(x[4])] = find(y[4])
    clusters = defaultdict(set)
    for x in nodes:
        clusters[find(x[4])].add(x)
    want = {x[:4]: min(y[0] for y in c) for c in clusters.values() if len({y[0] for y in c}) > 1 for x in c}
    rows = {(q.doc, q.start, q.end, q.words): (q.cluster_id, q.kept) for q in paragraphs.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(want) > 60 and want.keys() <= rows.keys()
    assert all(rows[k][0] <= v for k, v in want.items())  # a place may be a repeated run of an earlier document too
    windows = defaultdict(set)
    cut = {d: t.lower().split() for d, t in texts.items()}
    for d, w in cut.items():
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(d)
    for (d, start, end, n), (first, kept) in rows.items():
        assert kept == (d == first)
        if want.get((d, start, end, n)) == first:
            continue
        w = texts[d].encode()[start:end].decode().lower().split()
        assert len(w) == n and all(min(windows[tuple(w[i : i + 50])]) == first for i in range(n - 49))


def test_rounds_give_the_same_rows(spark, monkeypatch):
    """Bands go before buckets are verified, and a round sends the shingles of its own buckets only."""
    r = random.Random(5)
    passages = [sentences(r, n) for n in (60, 80, 120)]
    texts = [(d, "\n".join([sentences(r, 20), *(edited(r, p) for p in r.sample(passages, 2)), sentences(r, 30)])) for d in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    once = sorted(map(str, paragraphs.repeats(docs).collect()))
    rounds, links = [], paragraphs.links

    def spied(members, sets, n):
        rounds.append(n)
        assert {c for c in sets.columns} == {"content", "set", "lo", "hi"}
        return links(members, sets, n)

    monkeypatch.setattr(paragraphs, "links", spied)
    monkeypatch.setattr(paragraphs, "ROUND_MEMBERS", 40)
    assert sorted(map(str, paragraphs.repeats(docs).collect())) == once
    assert once and rounds == [paragraphs.ROUNDS]


def test_a_round_explodes_only_its_own_deals(spark, monkeypatch):
    """Members are dealt once, before the rounds: a round joins nothing, and all rounds together explode each member once."""
    r = random.Random(6)
    base = [np.sort(np.array(r.sample(range(10**9), 40), np.uint64)) for _ in range(30)]
    rows = [(9 * b + k, np.unique(np.append(s[: 40 - k % 5], np.uint64(b * 100 + k))).tobytes()) for b, s in enumerate(base) for k in range(9)]
    sets = spark.createDataFrame([(c, bytearray(s), c, c) for c, s in rows], "content long, set binary, lo long, hi long")
    sets = paragraphs.common.stored(sets, "source").select("content", "set", "lo", "hi")  # a stage's table, which its caller goes on to read
    members = spark.createDataFrame([(b, c) for c, _ in rows for b in (c // 9, 1000 + c // 18)], "bucket long, content long")
    plans, stored = [], paragraphs.common.stored

    def spied(df, name):
        if name == "links":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(paragraphs.common, "stored", spied)
    each = {n: {(x.node, x.root) for x in paragraphs.common.components(paragraphs.links(members, sets, n)).collect()} for n in (1, 4)}
    assert sets.count() == len(rows)
    assert each[1] == each[4] and len(each[1]) == len(rows)
    assert len(plans) == 5 and not any("Join" in p for p in plans)
    assert all(p.index("MapInArrow") < p.index("Generate explode(filter(deals") for p in plans)


def test_unlike_sets_are_not_merged(monkeypatch):
    """A bucket of sets that share half is settled by sketches; pairs at exactly SIMILARITY are kept, and all links are those of brute force."""
    r = np.random.default_rng(3)
    new = lambda n: r.integers(0, 2**63, n).astype(np.uint64)
    common = new(30)
    sets = [np.unique(np.append(common, new(25))) for _ in range(150)]
    for n in (9, 45, 90, 900):
        s = new(n)
        sets += [np.unique(s), np.unique(np.append(s[: n * 8 // 9], new(n // 9))), np.unique(np.append(s[n // 9 :], new(n // 9)))]
    sets.append(np.zeros(0, np.uint64))
    compared, jaccard = [], paragraphs.jaccard

    def spied(sets, i, j):
        compared.extend(zip(i.tolist(), j.tolist(), strict=True))
        return jaccard(sets, i, j)

    monkeypatch.setattr(paragraphs, "jaccard", spied)
    n = len(sets)
    root = paragraphs.verified(sets, np.full(n, n), np.arange(n), np.arange(n))
    want = list(range(n))
    for j in range(n):
        for i in range(j):
            if like(frozenset(sets[i].tolist()), frozenset(sets[j].tolist())):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert root.tolist() == want and len(set(want)) < n - 6
    assert len(compared) < 200


def test_a_task_sends_a_set_once(spark):
    """Bands go for two texts at most, the set with the first of them."""
    r = random.Random(8)
    passage = sentences(r, 120)
    docs = spark.createDataFrame([(d, f"{sentences(r, 30)}\n{passage}") for d in range(12)], "doc_id long, text string").coalesce(1)
    w = paragraphs.anchored(docs, "doc_id", "text").collect()
    wanted = spark.createDataFrame([(x.whole, x.doc, x.doc, x.anchors) for x in w], "whole long, lo long, hi long, anchors array<long>")
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        rows = [x for x in paragraphs.met(docs, "doc_id", "text", wanted).collect() if x.at < 0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    sent, banded = defaultdict(int), defaultdict(int)
    for x in rows:
        sent[x.content] += x.set is not None
        banded[x.content] += x.bands is not None
    assert set(sent.values()) == {1} and max(banded.values()) == 2
