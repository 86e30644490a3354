"""Indexes that are written and read again: recall against brute force over all vectors, folders that a search reads, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import approximate, graph, inverted
from orrery.operators.vectors import embeddings, recall, top_k

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    e = embeddings(spark, D).select("id", "v")
    truth = f"{tmp_path_factory.mktemp('truth')}/t"
    top_k(e, e, 5, "ip", same=True).write.parquet(truth)
    return e, spark.read.parquet(truth)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/i"
    inverted.write_index(vectors[0], path)
    return path


def test_inverted_lists(spark, vectors, index):
    e, truth = vectors
    lists = spark.read.parquet(f"{index}/centroids").count()
    assert lists == round(e.count() ** 0.5)
    stored = inverted.read_lists(spark, index)
    assert stored.groupBy("id").count().where("count <> 4").count() == 0 and stored.select("id").distinct().count() == e.count()
    assert recall(truth, inverted.search_vectors(spark, index, e, 5, 8), 5).first()[0] >= 0.9
    every = inverted.search_vectors(spark, index, e, 5, lists)  # all lists: exact
    assert recall(truth, every, 5).first()[0] == 1 and every.count() == 5 * e.count()


def test_a_search_reads_probed_folders_only(spark, vectors, index):
    one = vectors[0].where("id = 7")
    probes = inverted.probed(spark, index, one, 5)
    rows = inverted.list_rows(spark, index, probes, 2)
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
    wanted = {r["list"] for r in probes.where("rank <= 2").collect()}
    assert {r["list"] for r in rows.select("list").distinct().collect()} == wanted and len(wanted) == 2
    assert "ReadSchema: struct<id:bigint,code:binary>" in rows.select("id", "code")._jdf.queryExecution().executedPlan().toString()


def test_codes(spark, vectors, index):
    e, truth = vectors
    found = inverted.search_codes(spark, index, e, e, 5, 8)
    assert recall(truth, found, 5).first()[0] >= 0.9
    assert inverted.read_lists(spark, index).select(F.octet_length("code")).distinct().collect() == [(inverted.PARTS,)]
    assert 5 * inverted.WIDER <= 0.1 * e.count()  # candidates that exact products see


def test_distance_tables_equal_decoded_products():
    rng = np.random.default_rng(1)
    r, q = rng.normal(size=(300, 32)), rng.normal(size=32)
    books = inverted.trained_codebooks(r, 8, 16)
    code = inverted.codes_of(r, books)
    decoded = np.concatenate([books[p][code[:, p]] for p in range(8)], 1)
    tables = np.einsum("pw,pcw->pc", q.reshape(8, -1), books)
    assert np.allclose(tables[np.arange(8), code].sum(1), decoded @ q)
    near = np.stack([((r.reshape(300, 8, -1)[:, p, None] - books[p][None]) ** 2).sum(2).min(1) for p in range(8)], 1)
    assert np.allclose(((r - decoded) ** 2).reshape(300, 8, -1).sum(2), near)
    with pytest.raises(ValueError, match="divide"):
        inverted.trained_codebooks(r, 5)


def test_graph(spark, vectors, tmp_path):
    e, truth = vectors
    for shards in (1, 3):
        graph.write_graph(e, f"{tmp_path}/{shards}", shards)
        found = graph.search_graph(spark, f"{tmp_path}/{shards}", e, 5)
        assert recall(truth, found, 5).first()[0] >= 0.95 and found.count() == 5 * e.count()


def test_graph_is_navigable():
    """Stored blocks give the graph back; links are bounded; every node is found from the entry; fewer products than a scan makes."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2500, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = graph.Graph(np.arange(2500) * 3, v.astype("<f4").astype(float))
    g.build(graph.layers_of(g.ids))
    rows = [r for b in g.blocks(5) for r in b.to_pylist()]
    assert [r["block"] for r in rows] == [0, 1, 2] and {r["shard"] for r in rows} == {5}
    h = graph.Graph.of(rows)
    assert np.array_equal(g.lowest, h.lowest) and g.entry == h.entry and [x.keys() for x in g.upper] == [x.keys() for x in h.upper]
    assert len(g.upper) >= 2 and len(g.upper[1]) < len(g.upper[0]) < 2500 / 6
    seen, looked = np.zeros(2500, bool), 0
    for i in range(0, 2500, 50):
        assert h.search(v[i], 64, seen)[0][1] == i and not seen.any()

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal looked
            looked += len(self) if self.ndim == 2 else 1
            return np.asarray(self) @ np.asarray(other)

    h.vectors = h.vectors.view(Counted)
    h.search(v[1], 32, seen)
    assert looked < 1200


def test_edge_rows(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3), 0.5]) for i in range(60)] + [(None, [1.0] * 4), (100, None), (101, []), (5, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumns({"list": F.lit(1), "rank": F.lit("x")})
    asks = df.where("id = 5 and v[0] = 9")
    best = [r["doc_id"] for r in top_k(asks.select("id", "v"), df.where("id is not null").select("id", "v"), 3, "ip", same=True).orderBy("rank").collect()]
    inverted.write_index(df, f"{tmp_path}/i", 3, copies=2, parts=2)
    graph.write_graph(df, f"{tmp_path}/g")
    for found in (inverted.search_vectors(spark, f"{tmp_path}/i", asks, 3, 3), graph.search_graph(spark, f"{tmp_path}/g", asks, 3), approximate.lsh_search(df, asks, 3)):
        got = [r["doc_id"] for r in found.orderBy("rank").collect()]
        assert len(got) == 3 and got[0] == best[0] and 5 not in got
    graph.write_graph(df.limit(0), f"{tmp_path}/none")
    assert graph.search_graph(spark, f"{tmp_path}/none", asks, 3).count() == 0


def test_lsh_index_grows_as_the_rows_do(spark):
    """A vector is in as many buckets as there are tables, however many vectors there are; a query looks into its own bucket and those nearest to it."""
    shapes = [approximate.lsh_shape(n) for n in (2_000, 60_000, 600_000, 6_000_000)]
    assert len({tables for _, tables, _ in shapes}) == 1
    df = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(50)], "id long, v array<double>")
    own, near = (approximate.buckets(df, 5, 4, n).collect() for n in (1, 6))
    assert len(own) == len(set(own)) == 4 * 50 and len(near) == len(set(near)) == 6 * 4 * 50
    assert set(own) <= set(near)


def test_lsh_looks_into_more_buckets_where_vectors_are_few():
    """The nearest of few vectors are far away: at 500 three buckets of eight missed 3 of 25 neighbours."""
    assert [approximate.lsh_shape(n)[2] for n in (0, 500, 4_096)] == [8, 8, 8]
    assert [approximate.lsh_shape(n)[2] for n in (10_256, 51_282, 615_384)] == [3, 6, 54]  # as many as neighbours at 60 degrees need
