"""The divergence audit against brute force in Python's whole numbers, over any blocks; exactness, ties, nulls."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import divergence as dv
from test_llm_operators import edge_docs, empty_docs


def brute(docs, min_docs=10):
    lower = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    each = [(a or "", s or "", [lower(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for a, s, t in docs]
    out = []
    for lang in {a for a, _, _ in each}:
        df = Counter(w for a, _, ws in each if a == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for a, s, ws in each:
            if a == lang:
                counts[s].update(w for w in ws if w in set(kept))
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        q, of = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(-sum(f(of[s][w], of[o][w]) for w in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(of[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and of[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, x, -v, k + 1) for k, (v, _, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("terms", "groups", "held"), [(2048, 64, 400_000), (3, 2, 50), (7, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, terms, groups, held):
    for name, v in (("BLOCK_TERMS", terms), ("BLOCK_GROUPS", groups), ("HELD", held)):
        monkeypatch.setattr(dv, name, v)
    r = random.Random(5)
    words = ["Alpha", "BETA", "beta", "é", "É", "x-y", "a1b", "漢字", *(f"w{chr(97 + k)}" for k in range(20))]
    more = [(k, " ".join(r.choice(words[k % 5 :]) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "de", None]), r.choice(["s0", "s1", "s2", "é", "z", None, ""]), 0) for k in range(300)]
    more += [(400, "only here", "xx", "a", 0), (401, None, "xx", "b", 0), (402, "", "xx", "c", 0), (403, "en", "en", "bare", 0), *[(404, "tie kit", "tt", s, 0) for s in "ab" for _ in range(10)]]
    docs = edge_docs(spark, *more).repartition(3)
    want = brute([(x["lang"], x["source"], x["text"]) for x in docs.collect()])
    got = sorted(map(tuple, dv.divergence(docs).collect()))
    assert got == want
    assert {("xx", "a", "pair", "b", 0, 1), ("tt", "a", "pair", "b", 0, 1)} <= set(got)


def test_shares_are_exact_beyond_doubles():
    count = np.array([0, 1, 10**6 + 7, 4 * 10**15 + 3], np.int64)
    total = int(count.sum())
    assert dv.shares(count, total, 4).tolist() == [1 + 10**9 * (c + 2) // (total + 8) for c in count.tolist()]


def test_heaps_keep_ties_by_bytes():
    h = dv.Heaps()
    h.offer(0, np.zeros(30, np.int64), [f"{k:02}".encode() for k in range(30)][::-1])
    h.offer(0, np.array([0, 5]), [b"00x", b"zz"])
    assert h.held[0][:3] == [(-5, b"zz"), (0, b"00"), (0, b"00x")] and len(h.held[0]) == dv.TOP


def test_empty_and_clashing_names(spark):
    assert dv.divergence(empty_docs(spark)).count() == 0
    docs = spark.createDataFrame([(1, "a b", "en", s, 0) for s in "xy" for _ in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"term": F.lit(1), "n": F.lit(2), "total": F.lit(3), "place": F.lit(4)})
    assert sorted(map(tuple, dv.divergence(docs).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
