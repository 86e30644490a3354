"""One pass of several tolerances against a replay of each, and its state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import cache


def queries(spark, n=600, keys=5):
    rng = np.random.default_rng(2)
    pool = np.round(rng.normal(size=(40, 4)), 1)
    return spark.createDataFrame([(int(rng.integers(0, keys)), i, int(p := rng.integers(0, 40)), pool[p].tolist()) for i in range(n)], "key long, seq long, id long, v array<double>")


@pytest.mark.parametrize("capacity", [1, 3, 32])
def test_sweep_equals_replays(spark, capacity):
    q, tolerances = queries(spark), (0.0, 0.4, 1.0, 2.5)
    want = [tuple(cache.replay(q, capacity, t, "fifo").agg(F.count("*"), F.count_if("hit")).first()) for t in tolerances]
    got = {r.tolerance: (r.queries, r.hits) for r in cache.sweep(q, capacity, tolerances).collect()}
    assert [got[t] for t in tolerances] == want
    assert len(set(want)) > 1


def test_no_queries_have_no_hits(spark):
    assert [tuple(r) for r in cache.sweep(queries(spark).where("false"), 4, (0.0, 1.0)).collect()] == [(0.0, 0, 0), (1.0, 0, 0)]


def test_places_are_reused():
    caches = cache.FifoSweep(3, (0.0, 0.5), 2)
    for x in np.random.default_rng(1).normal(size=(500, 2)):
        caches.see(x)
        assert all(len(h) <= 3 for h in caches.held)
    assert caches.keys.shape == (6, 2) and sum(caches.users) == sum(map(len, caches.held))
