"""Model interfaces, agent loops, service surroundings, cache policies, files."""

import os

import numpy as np
import pytest
from oracle import agrees
from pyspark.sql import functions as F

from orrery.functions import models
from orrery.operators import cache
from orrery.plans import agents, serving
from orrery.registry import ORACLE_SQL, QUERIES
from orrery.sources import readers
from orrery.streaming import windows


def test_generator_stops_and_counts():
    a, b, c = models.FirstWords()(["x\none two. three", "y\n" + "w " * 9, ""], models.Sampling(max_tokens=5, stop=(". ",)))
    assert (a.text, a.finish, a.tokens_in) == ("one two", "stop", 4) and (b.tokens_out, b.finish) == (5, "length") and c == models.Generated("", 0, 0, "stop")


def test_max_tokens():
    both = {"max_new_tokens": 3, "max_tokens": 9}
    assert models.max_tokens(both) == 3 and models.max_tokens(both, new_first=False) == 9 and models.max_tokens({"max_tokens": "7"}) == 7 and models.max_tokens({}, 5) == 5


def test_rating_without_a_number(spark):
    class Silent:
        def __call__(self, pairs):
            return ["no idea" if not a else f"I say. Rating: {len(a)} of 10" for _, a in pairs]

    rows = spark.createDataFrame([(1, "q", "abcd"), (2, None, None)], "id long, q string, a string")
    assert {r.id: r.score for r in models.rated(rows, Silent(), "id", "q", "a").collect()} == {1: 0.4, 2: 0.0}


def test_routes(spark):
    rows = spark.createDataFrame([("Who is it",), (" ".join(["w"] * 15),), (", ".join(["long part of it all"] * 8),)], "q string")
    assert [r[0] for r in rows.select(models.routed(F.col("q"))).collect()] == ["A", "B", "C"]


def test_agents_stop(spark):
    hits = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2), (4, 1, 5), (5, 1, 6), (6, 1, 7), (7, 1, 8)], "qid long, rank int, doc_id long")
    items = spark.createDataFrame([(1,), (4,), (9,)], "qid long")
    asked = []

    def search(places):
        asked.append(sorted(r[0] for r in places.collect()))
        return hits.withColumnRenamed("qid", "at").join(places, "at")

    got = {r.qid: (r.read, r.finish) for r in agents.agent_loop(search, items, searches=4).collect()}
    assert got == {1: ([2, 3], "repeat"), 4: ([5, 6, 7, 8], "limit"), 9: ([], "repeat")}
    assert asked == [[1, 4, 9], [2, 5], [3, 6], [7]]  # each round from the places of active items, no place twice
    assert {r.qid: r.finish for r in agents.agent_loop(search, items, searches=9, turns=2).collect()} == {1: "turns", 4: "turns", 9: "repeat"}


def test_tree_takes_the_best_mean(spark):
    hits = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 0.4), (3, 1, 4, 0.9), (2, 1, 5, 0.1), (9, 1, 8, 0.7)], "qid long, rank int, doc_id long, score double")
    items = spark.createDataFrame([(1,), (9,), (77,)], "qid long")
    got = agents.refinement_tree(lambda places: hits.withColumnRenamed("qid", "at").join(places, "at"), items)
    assert {(r.qid, r.answer, r.confidence) for r in got.collect()} == {(1, 4, 0.65), (9, 8, 0.7)}


def test_lookups_raise(spark):
    hits = spark.createDataFrame([(1, 10), (2, -1), (3, 11)], "qid long, doc_id long")
    store = spark.createDataFrame([(10, "a")], "doc_id long, t string")
    with pytest.raises(KeyError, match="11"):
        serving.assembled(hits, store)
    assert serving.assembled(hits.where("qid < 3"), store).count() == 1


def test_hits_without_a_passage_keep_a_row_with_an_error(spark, tmp_path):
    spark.createDataFrame([(k, [1.0, 0.1 * k], 0) for k in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["passages_or_error"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 * 2 and all((r.text_md5 is None) != (r.error is None) for r in rows)
    assert {r.doc_id: r.error for r in rows} == {1: None, 2: "id without a passage: 2", 3: "id without a passage: 3"}
    agrees(spark, QUERIES["passages_or_error"], ORACLE_SQL["passages_or_error"], str(tmp_path))


def test_configuration():
    with pytest.raises(ValueError, match="recall"):
        serving.evaluated(None, ("em", "recall"))
    assert serving.checked_template("Q: {question}", "question") and pytest.raises(ValueError, serving.checked_template, "Q:", "question")
    full, warned = serving.checked_retriever({"method": "bge-small", "pooling": "mean"})
    assert full["topk"] == 5 and len(warned) == 1 and not serving.checked_retriever({"method": "e5"})[1]
    for bad in ({"top": 1}, {"topk": "5"}, {"topk": 0}, {"cache": "lru"}):
        with pytest.raises(ValueError):
            serving.checked_retriever(bad)


def test_retries():
    seen = []

    def call():
        seen.append(1)
        if len(seen) < 3:
            raise ConnectionError
        return "ok"

    assert serving.retried(call, pause=0) == "ok" and len(seen) == 3
    with pytest.raises(ZeroDivisionError):
        serving.retried(lambda: 1 // 0)


@pytest.mark.parametrize("policy", cache.POLICIES)
def test_cache_against_a_plain_one(policy):
    """Tolerance 0 against lists of ids in each bucket."""
    rng = np.random.default_rng(3)
    keys = rng.normal(size=(40, 8))
    c, plain = cache.ProximityCache(5, 0.0, policy), {}
    planes = np.random.default_rng(cache.BUCKET_SEED).normal(size=(cache.BUCKET_BITS, 8))
    for i in rng.integers(0, 40, 600).tolist():
        held = plain.setdefault(tuple(planes @ keys[i] >= 0) if policy.startswith("lsh") else 0, [])
        want = i if i in held else None
        assert c.find(keys[i]) == want
        if want is None:
            c.insert(keys[i], i)
            del held[: max(0, len(held) - 4)]
            held.append(i)
        elif policy.endswith("lru"):
            held.remove(i)
            held.append(i)
        assert all(len(b) <= 5 for b in c.buckets.values()) and sorted(v for _, v in c.held.values()) == sorted(x for h in plain.values() for x in h)


def test_read_through_keeps_the_order():
    c, asked = cache.ProximityCache(9, 0.1), []
    fetch = lambda at: asked.append(at) or [f"r{i}" for i in at]
    keys = [np.array([float(i)]) for i in (1, 2, 1)]
    assert c.read_through(keys, fetch) == ["r0", "r1", "r2"] and c.read_through([*keys[1:], np.array([7.0])], fetch) == ["r1", "r0", "r2"]
    assert asked == [[0, 1, 2], [2]]


def test_files(spark, tmp_path):
    assert readers.resolve_path("s3://b/k", "/r") == "s3a://b/k" and readers.resolve_path("/a", "/r") == "/a" and readers.resolve_path("x/y", "/r/") == "/r/x/y"
    src, dst = tmp_path / "a", tmp_path / "b"
    src.mkdir()
    (src / "train.jsonl").write_text("{}\n")
    assert readers.dataset_splits(spark, str(src), str(dst)) == ["train"] and readers.dataset_splits(spark, str(src), str(dst)) == []
    assert readers.directory_size(spark, str(dst)) >= 3 and readers.directory_size(spark, str(tmp_path / "none")) == 0 and not any(x.endswith(".partial") for x in os.listdir(dst))
    got = readers.read_documents_of(spark, str(src), lambda raw: raw.decode() + " a b c" if len(raw) else 1 // 0, words=3).first()
    assert got.text == "{} a b" and got.error is None
    out = tmp_path / "put"
    out.mkdir()

    def put(batch):
        (out / batch[0]["key"]).write_text(str(len(batch)))

    readers.put_vectors(spark.range(0, 1100, 1, 1).select("id", F.array(F.lit(0.5)).alias("v")), put)
    assert sorted(int(p.read_text()) for p in out.iterdir()) == [100, 500, 500]


def test_union_of_keys_and_health(spark):
    a, b = spark.createDataFrame([(1, 2)], "z long, a long"), spark.createDataFrame([("x",)], "m string")
    assert serving.union_of_keys(a, b).columns == ["a", "m", "z"] and serving.health(spark) == []


def test_scratch_needs_a_shared_folder():
    class Spark:
        class conf:
            get = staticmethod(lambda k, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        windows.scratch(Spark, "x")
