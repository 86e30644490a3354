"""The threshold join against all pairs by brute force; blocks that angles pass over; edge rows."""

import numpy as np
import pytest

from orrery.operators import rank, similarity
from pyspark.sql import functions as F


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return centres[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, dim))


def brute(x, least):
    u = x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]
    s = np.floor(np.round(u @ u.T, 9) * 1e6 + 0.5 + 1e-7) / 1e6  # half up, as SQL rounds
    i, j = np.nonzero(np.triu(s >= least, 1))
    return {(a, b, round(float(s[a, b]), 6)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}


@pytest.mark.parametrize("least", [0.2, 0.9, 0.99, 1.0])
def test_equals_brute_force(spark, monkeypatch, least):
    """More than twenty neighbours over the threshold, several groups, copies, a zero vector."""
    for name, v in (("BLOCK", 16), ("GROUP", 100)):
        monkeypatch.setattr(similarity, name, v)
    x = clustered(450, 24)
    x[7] = x[8] = x[400]
    x[9] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 24), (9001, None), (9002, [])], "id long, v array<double>")
    got = {tuple(r) for r in similarity.cosine_join(rows, least).collect()}
    assert got == brute(x, least)
    assert {(7, 8), (7, 400), (8, 400)} <= {r[:2] for r in got}
    if least == 0.9:
        assert max(np.bincount([a for a, *_ in got])) > 20


def test_blocks_far_apart_are_passed_over():
    rng = np.random.default_rng(3)
    at = np.eye(24)[:2]
    a, b = (similarity.Block(np.arange(50), similarity.unit(c + 0.05 * rng.normal(size=(50, 24)))) for c in at)
    assert a.pairs(b, 0.8) is None and a.pairs(a, 0.8)[0].size == 2500
    assert similarity.Block(np.arange(2), np.array([[1.0, 0.0], [-1.0, 0.0]])).centre is None  # no direction: never passed over


def test_pairs_at_the_threshold_are_told_apart_by_eight_bytes():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 24))
    a, b = similarity.Block(np.arange(200), similarity.unit(x)), similarity.Block(np.arange(200), similarity.unit(x[::-1] + 0.3 * rng.normal(size=x.shape)))
    s = a.x @ b.x.T
    for least in np.sort(s[s > 0.05])[::997].tolist():  # at a pair's own similarity, four bytes cannot tell
        a.middle = b.middle = 1.0
        i, j, sim = a.pairs(b, least, exact=False)
        near = abs(sim - least) < 1e-6
        assert np.abs(sim[near] - s[i, j][near]).max() < 1e-14
        assert {*zip(i[sim >= least - 1e-12], j[sim >= least - 1e-12], strict=True)} == {*zip(*np.nonzero(s >= least - 1e-12), strict=True)}


def test_thresholds(spark):
    rows = spark.createDataFrame([], "id long, v array<double>")
    assert similarity.cosine_join(rows, 0.5).count() == 0
    for bad in (0, -0.5, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            similarity.cosine_join(rows, bad)


@pytest.fixture
def compared(spark, tmp_path, monkeypatch):
    """(folder, similarities, neighbour lists) of vectors in several groups, with copies."""
    for name, v in (("BLOCK", 16), ("GROUP", 100)):
        monkeypatch.setattr(similarity, name, v)
    x = clustered(300, 12)
    x[7] = x[8] = x[200]
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    return str(tmp_path), {(i, j): c for i, j, c in brute(x, 0.3)}, [np.lexsort((np.arange(300), -r))[:10].tolist() for r in s]


def test_lists_are_compared_where_pairs_are_found(spark, compared):
    d, sims, lists = compared
    same = {p: [len({*lists[p[0]][:k]} & {*lists[p[1]][:k]}) for k in range(1, 11)] for p in sims}
    got = {(r.i, r.j, r.k): (r.overlap, r.jaccard, r.mismatch) for r in rank.q_overlap_jaccard(spark, d).collect()}
    assert len(got) == 2 * len(sims)
    for (i, j, k), v in got.items():
        n = same[i, j][k - 1]
        assert v == pytest.approx((n / k, n / (2 * k - n), 1 - n / k), abs=1e-6)
    got = {(r.i, r.j): r.rbo for r in rank.q_rbo(spark, d).collect()}
    assert got == pytest.approx({p: 0.1 * sum(0.9**e * n / (e + 1) for e, n in enumerate(c)) for p, c in same.items()}, abs=1e-6)
    tally = rank.compared(spark, d, rank.Tally).agg(F.sum("n"), F.count("*")).first()
    assert tally[0] == len(sims) > tally[1]  # outcomes, not pairs, leave a cell


def test_a_cell_gives_no_more_pairs_of_a_bin_than_the_cap(spark, compared):
    d, sims, _ = compared
    own = similarity.cosine_join(rank.embeddings(spark, d), 0.3, rank.least_of_bins(5, 7))
    everything = rank.similar_pairs(spark, d, 0.3).withColumn("bin", rank.pair_bin(F.col("sim"), True))
    want = {(r.i, r.j, r.bin) for r in rank.capped(everything, 5, 7).collect()}
    assert {(r.i, r.j, r.bin) for r in rank.capped(own, 5, 7).collect()} == want
    assert own.count() < len(sims) / 4


def test_common_ids_at_each_depth():
    a, b = np.array([[1, 2, 3], [4, -1, -1]]), np.array([[2, 9, 1], [-1, 4, -1]])
    assert rank.commons(a, b).tolist() == [0 * 1 + 1 * 2 + 2 * 6, 0 * 1 + 1 * 2 + 1 * 6]
