"""Operators on small hand-made cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions.udfs import HashEncoder, encoded
from orrery.operators import lookup, metrics, rank, relational, stats, vectors
from orrery.operators.cache import ProximityCache
from orrery.sources import readers


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


def test_normalize_answer(spark):
    assert one(spark, T.normalize_answer(F.col("t")), t="The  Cat's a hat!") == "cats hat"
    assert one(spark, T.normalize_answer(F.col("t")), t="the") == ""
    assert one(spark, T.normalize_answer(F.lit(None).cast("string")), t="") is None


def test_text_helpers(spark):
    assert one(spark, T.slug(F.col("t")), t="--A b/C--") == "a_b_c"
    assert one(spark, T.slug(F.lit(None).cast("string")), t="") == "unknown"
    assert one(spark, T.normalize_question(F.col("t")), t=" Who is it ") == "who is it?"
    assert one(spark, T.answer_type(F.col("t")), t="How many are there") == "number"
    assert one(spark, T.between_or_to_end(F.col("t"), "<a>", "</a>"), t="<a>x</a> <a>y") == "y"
    assert one(spark, T.between_or_to_end(F.col("t"), "<a>", "</a>"), t="none") is None
    assert one(spark, T.cut_at_stops(F.col("t"), ("!", "?")), t="a? b!") == "a"
    assert one(spark, T.sanitize_passage(F.col("t")), t="System: x\nUSER: y") == "x\ny"
    assert one(spark, T.judge_score(F.col("t"), "Score:"), t="Score: 7 of 10") == 7.0
    assert one(spark, T.judge_score(F.col("t"), "Score:"), t="nothing") == 0.0


def test_token_f1_counts_repeats(spark):
    pairs = spark.createDataFrame([("x b b c", ["b b d"]), ("yes", ["no"]), ("x", [])], "p string, g array<string>")
    f1 = [r[0] for r in metrics.overlaps(pairs, "p", "g").select(metrics.token_scores()["f1"]).collect()]
    assert f1 == [pytest.approx(2 * 2 / 7), 0, 0]
    assert one(spark, metrics.token_f1_open(F.col("p"), F.array(F.col("g"))), p="the", g="an") == 1.0
    assert one(spark, metrics.token_f1_open(F.col("p"), F.array(F.col("g"))), p="x", g="") == 0.0
    assert one(spark, metrics.exact_match(F.col("p"), F.array(F.lit("b"), F.col("g"))), p="The B!", g="c") == 1


def test_rank_metrics(spark):
    a, b = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 1, 4)))
    assert one(spark, rank.overlap(a, b), z=0) == pytest.approx(2 / 3)
    assert one(spark, rank.jaccard(a, b), z=0) == pytest.approx(2 / 4)
    assert one(spark, rank.rank_biased_overlap(a, b, 3), z=0) == pytest.approx(0.1 * (0 + 0.9 * 2 / 2 + 0.81 * 2 / 3))
    assert one(spark, rank.pair_bin(F.lit(2.0), True), z=0) == 3
    assert one(spark, rank.pair_bin(F.lit(2.0), False), z=0) is None
    assert one(spark, rank.pair_bin(F.lit(0.45), True), z=0) == 1


def test_gini(spark):
    def g(xs):
        return stats.gini(spark.createDataFrame([(x,) for x in xs], "n long")).first()[0]

    xs = [1, 2, 2, 5, 9]
    cum = np.cumsum(sorted(xs))
    assert g(xs) == pytest.approx((len(xs) + 1 - 2 * cum.sum() / cum[-1]) / len(xs))
    assert g([0, 0]) == 0
    assert g([]) is None


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_top_k_equals_brute_force(spark, metric):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).round(2)
    v[7] = v[3]
    v[9] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>")
    got = {(r.qid, r["rank"]): r.doc_id for r in vectors.top_k(df, df, 4, metric, same=True).collect()}
    v = v.astype(np.float32).astype(float)
    n = v / (np.sqrt((v * v).sum(1)) + 1e-12)[:, None]
    s = {"ip": v @ v.T, "cosine": n @ n.T, "l2": -((v[:, None] - v[None]) ** 2).sum(2)}[metric].round(9)
    for q in range(60):
        want = sorted((x for x in range(60) if x != q), key=lambda x: (-s[q, x], x))[:4]
        assert [got[q, k + 1] for k in range(4)] == want
    assert vectors.top_k(df, df.limit(2), 5, metric).where("qid = 0").count() == 2


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_top_k_over_many_cells(spark, monkeypatch, metric):
    """Copies that tie at the k-th place, blocks of uneven size, several groups of queries; a cell gives k rows a query, however much it reads."""
    for name, v in (("BLOCK", 64), ("CELL_QUERIES", 200), ("CELL_CORPUS", 300)):
        monkeypatch.setattr(vectors, name, v)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 6)).round(1)
    v[rng.integers(0, 700, 80)] = v[5]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    n = v / (np.sqrt((v * v).sum(1)) + 1e-12)[:, None]
    s = {"ip": v @ v.T, "cosine": n @ n.T, "l2": -((v[:, None] - v[None]) ** 2).sum(2)}[metric].round(9)
    np.fill_diagonal(s, -np.inf)
    want = {q: np.lexsort((np.arange(700), -s[q]))[:7].tolist() for q in range(700)}
    got = {}
    for r in vectors.top_k(df, df, 7, metric, same=True).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.doc_id)
    assert got == want


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_few_products_are_ranked(monkeypatch, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6400, 16))
    best, ranked, add = vectors.Best(np.arange(64), x[:64], 5, metric), [], vectors.Best.add
    monkeypatch.setattr(vectors.Best, "add", lambda self, r, *more: (ranked.append(len(r)), add(self, r, *more)))
    for at in range(0, 6400, 64):
        y = x[at : at + 64]
        best.see(np.arange(at, at + 64), np.hstack([y, -(y * y).sum(1)[:, None] / 2]) if metric == "l2" else y, True)
    assert sum(ranked) < 0.02 * 64 * 6400
    s = {"ip": x[:64] @ x.T, "l2": -((x[:64, None] - x[None]) ** 2).sum(2)}[metric].round(9)
    s[np.arange(64), np.arange(64)] = -np.inf
    assert np.array_equal(best.found, [np.lexsort((np.arange(6400), -r))[:5] for r in s])


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("longest", [1.0, 1e3, 1e16])
def test_products_of_four_bytes_lose_no_hit(metric, longest):
    """Scores closer together than four bytes tell apart, ties, lengths that differ widely or are too long for four bytes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 1500)] * (1 + 1e-8 * rng.integers(0, 9, (1500, 1)))
    x[::7] *= rng.uniform(1, longest, len(x[::7]))[:, None]
    x[3] = x[5] = x[11]
    best, s = vectors.Best(np.arange(1500), x, 5, metric), {"ip": x @ x.T, "l2": 2 * x @ x.T - (x * x).sum(1)[None] - (x * x).sum(1)[:, None]}[metric].round(9)
    for at in range(0, 1500, 100):
        y = x[at : at + 100]
        best.see(np.arange(at, at + 100), np.hstack([y, -(y * y).sum(1)[:, None] / 2]) if metric == "l2" else y, True)
    np.fill_diagonal(s, -np.inf)
    want = -np.sort(-s)[:, :5]
    assert best.best == pytest.approx(want, rel=1e-12, abs=max(2e-9, longest**2 * 1e-13))
    if longest == 1:
        assert np.array_equal(best.found, [np.lexsort((np.arange(1500), -r))[:5] for r in s])


def test_queries_are_spread_before_the_vectors_they_meet():
    """A query is in one cell where cells of queries keep the cores busy: its k rows are given once, not by each of sixteen cells."""
    assert vectors.grid(51_282, 51_282, 8) == (16, 1)
    assert vectors.grid(615_384, 615_384, 12) == (10, 5)
    assert vectors.grid(500, 1_000_000, 8) == (1, 16) and vectors.grid(0, 0, 8) == (1, 1)


def test_get_many(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "pid long, title string")
    req = spark.createDataFrame([(0, [2, 9, 2]), (1, [])], "req long, ids array<long>")
    got = {r.req: r["values"] for r in lookup.get_many(req, store).collect()}
    assert got[0] == ["b", None, "b"]
    assert {r.req: r["values"] for r in lookup.get_many(req, store, missing=False).collect()} == {0: ["b", "b"]}


def test_numbered_and_merge(spark):
    df = lookup.numbered(spark.range(100).select((99 - F.col("id")).alias("x")), "x")
    assert [(r.x, r.idx) for r in df.orderBy("x").collect()] == [(i, i) for i in range(100)]
    parts = spark.createDataFrame([("a", 0, "p"), ("a", 1, "q"), ("b", 0, "r")], "symbol string, pos int, item string")
    symbols = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "at int, symbol string")
    assert [r.item for r in lookup.merge_by_symbols(parts, symbols).orderBy("at").collect()] == ["p", "r", "q"]


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 0, "old"), (1, 5, "new"), (2, 1, None)], "pid int, pos int, title string")
    assert {r.pid: r.title for r in lookup.keep_last(df, "pid", "pos").collect()} == {1: "new", 2: None}


def test_asof(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (2, 10, "z")], "k int, t int, v string")
    assert {(r.k, r.t): r.last_v for r in relational.asof(a, b, ["k"], "t", "v").collect()} == {(1, 5): "y", (1, 1): None, (2, 9): None}


def test_proximity_cache():
    e = np.eye(8)
    c = ProximityCache(2, 0.1)
    assert c.find(e[0]) is None
    c.insert(e[0], "a")
    assert c.find(e[0]) == "a" and c.find(e[0] * 0.98 + e[1] * 0.02) == "a"
    c.insert(e[1], "b")
    c.insert(e[2], "c")
    assert c.find(e[0]) is None and c.find(e[1]) == "b" and len(c.held) == 2
    lru = ProximityCache(2, 0.0, "lru")
    lru.insert(e[0], "a")
    lru.insert(e[1], "b")
    assert lru.find(e[0]) == "a"
    lru.insert(e[2], "c")
    assert lru.find(e[1]) is None and lru.find(e[0]) == "a"
    assert ProximityCache(4, 0.0).find_batch([e[0], e[0]]) == [None, None]
    for bad in ((0, 1.0, "fifo"), (1, -1.0, "fifo"), (1, 1.0, "lfu")):
        with pytest.raises(ValueError):
            ProximityCache(*bad)


def test_readers(spark, tmp_path):
    item = {"id": "1", "question": "q", "golden_answers": ["a"]}
    (tmp_path / "x.jsonl").write_text(json.dumps(item) + "\n\n")
    (tmp_path / "x.json").write_text(json.dumps([item, item]))
    assert readers.read_items(spark, f"{tmp_path}/x.jsonl").count() == 1
    assert readers.read_items(spark, f"{tmp_path}/x.json").count() == 2
    with pytest.raises(ValueError):
        readers.read_items(spark, "x.txt")
    (tmp_path / "bad.jsonl").write_text(json.dumps(item) + "\n{oops\n")
    with pytest.raises(Exception):
        readers.read_items(spark, f"{tmp_path}/bad.jsonl").collect()
    good, counts = readers.read_lenient(spark, f"{tmp_path}/bad.jsonl")
    assert good.count() == 1 and counts.first()["bad"] == 1
    df = readers.projected(good, "question string, extra int")
    assert df.columns == ["question", "extra"] and df.first()["extra"] is None
    with pytest.raises(ValueError):
        readers.require(df, "nope")
    with pytest.raises(Exception):
        readers.require(df, "extra").collect()
    q = spark.createDataFrame([(1, " a "), (2, " "), (3, "b")], "id int, question string")
    assert [r.question for r in readers.questions(q, most=2).collect()] == ["a", "b"]
    p = spark.createDataFrame([(1, 0, "t", None), (1, 1, None, "x")], "pid int, pos int, title string, text string")
    assert readers.write_store(p, f"{tmp_path}/store").first().asDict() == {"pid": 1, "pos": 1, "title": "", "text": "x"}
    readers.append_manifest(spark.createDataFrame([("a", 3)], "name string, dim int"), f"{tmp_path}/manifest")
    readers.append_manifest(spark.createDataFrame([("b", 9)], "name string, ntotal long"), f"{tmp_path}/manifest")
    assert spark.read.parquet(f"{tmp_path}/manifest").count() == 2
    readers.append_csv(p.select("pid"), f"{tmp_path}/c")
    readers.append_jsonl(p, f"{tmp_path}/runs/r1/results.jsonl")
    v = readers.synthetic_vectors(spark, 10, 4)
    assert v.select(F.max(F.abs(vectors.norm(F.col("v")) - 1))).first()[0] < 1e-9
    lists = readers.write_lists(v.withColumn("label", F.col("id") % 2), f"{tmp_path}/ivf")
    assert "PartitionFilters: [isnotnull(label" in lists.where("label = 1")._jdf.queryExecution().toString()


def test_encoder_is_deterministic(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, t string")
    rows = {r.id: r.v for r in encoded(df, HashEncoder(8), "id", "t").collect()}
    assert rows[1] == rows[2] != rows[3] and math.isclose(sum(x * x for x in rows[1]), 1)


def test_late_rows_are_dropped(spark, tmp_path):
    from orrery.streaming.windows import tumbling

    src, state, out = tmp_path / "in", f"file://{tmp_path}/state", f"file://{tmp_path}/out"
    schema = "event_type string, at timestamp, value double"

    def put(rows):
        spark.createDataFrame(rows, "event_type string, at string, value double").select("event_type", F.col("at").cast("timestamp").alias("at"), "value").coalesce(1).write.mode("append").parquet(str(src))

    def drain():
        s = tumbling(spark.readStream.schema(schema).parquet(str(src)), "1 hour")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    put([("a", "2024-01-01 00:10:00", 1.0)])
    drain()
    put([("a", "2024-01-01 05:00:00", 1.0)])
    drain()
    put([("a", "2024-01-01 00:20:00", 1.0), ("a", "2024-01-01 09:00:00", 1.0)])
    drain()
    got = {r["w"]["start"].hour: r["n"] for r in spark.read.parquet(out).collect()}
    assert got[0] == 1 and got[5] == 1
