"""The streaming cache against the batch cache: any micro-batches, rows out of order, late rows, bounded and expiring state."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators.cache import ProximityCache
from orrery.streaming import caches
from orrery.streaming.windows import drained

SCHEMA = "key long, id long, time timestamp, value long, v array<double>"


def run(spark, tmp_path, batches, **kw):
    """Each batch a file, one file a micro-batch."""
    src = f"{tmp_path}/src"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(a, b, t / 1e6, c, v) for a, b, t, c, v in rows], "key long, id long, t double, value long, v array<double>").withColumn("time", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long"))).drop("t").coalesce(1).write.mode("append").parquet(f"{src}/{k:03}")
    s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    with caches.state_store(spark):
        return drained(caches.cached_stream(s, **kw), "append", "test-cache").collect()


def replayed(rows, capacity, tolerance, policy):
    held, out = defaultdict(lambda: ProximityCache(capacity, tolerance, policy)), {}
    for key, i, at, value, v in sorted(rows, key=lambda r: (r[2], r[1])):
        found = held[key].find(np.array(v))
        if found is None:
            held[key].insert(np.array(v), value)
        out[i] = (found is not None, value if found is None else found)
    return out


@pytest.mark.parametrize("policy", ["lru", "fifo"])
def test_batches_do_not_matter(spark, tmp_path, policy):
    """Rows up to five seconds out of order across four micro-batches; a last batch moves the watermark past them all."""
    r = random.Random(6)
    rows = [(r.randint(1, 2), k, 1_000_000_000 + 500_000 * k, k, [float(r.randint(0, 6)), float(r.randint(0, 1))]) for k in range(120)]
    order = sorted(rows, key=lambda x: x[2] + r.randint(0, 4_000_000))
    batches = [order[k : k + 30] for k in range(0, 120, 30)] + [[(9, 999, 2_000_000_000, 0, [0.0, 0.0])]]
    got = {x["id"]: (x["hit"], x["source"]) for x in run(spark, tmp_path, batches, capacity=3, tolerance=1.0, policy=policy, delay="10 seconds") if x["key"] != 9}
    assert got == replayed(rows, 3, 1.0, policy)
    assert 20 < sum(h for h, _ in got.values()) < 120


def test_late_rows_are_dropped_and_idle_keys_cleared(spark, tmp_path):
    v = [1.0, 2.0]
    s = 1_000_000
    batches = [[(1, 1, 1000 * s, 10, v), (1, 2, 1005 * s, 20, v)], [(2, 3, 1100 * s, 30, v)], [(1, 4, 1001 * s, 40, v)], [(1, 5, 1130 * s, 50, v), (2, 6, 1131 * s, 60, v)], [(3, 7, 3000 * s, 70, v)]]
    got = {x["id"]: (x["hit"], x["source"]) for x in run(spark, tmp_path, batches, capacity=4, tolerance=0.0, policy="fifo", delay="1 second", idle_ms=60_000)}
    assert got[1] == (False, 10) and got[2] == (True, 10)
    assert 4 not in got  # the watermark stood at 1099 s
    assert got[5] == (False, 50)  # key 1 was idle for over a minute
    assert got[6] == (True, 30)


def test_bad_values_raise():
    for bad in ((0, 0.0, "lru"), (4, -1.0, "lru"), (4, 0.0, "lsh_lru"), (4, 0.0, "best")):
        with pytest.raises(ValueError, match="capacity|fifo or lru"):
            caches.CacheProcessor(*bad)


def test_state_is_bounded(spark, tmp_path):
    """Four thousand different vectors of one key leave ``capacity`` entries."""
    rows = [(1, k, 1_000_000_000 + k * 1000, k, [float(k)]) for k in range(400)]
    made = []
    processor = caches.CacheProcessor(8, 0.0, "lru")

    class State(dict):
        def updateValue(self, k, v): self[k] = v
        def getValue(self, k): return self[k]
        def removeKey(self, k): del self[k]
        def iterator(self): return iter(list(self.items()))

    class Value:
        held = None
        def exists(self): return self.held is not None
        def get(self): return self.held
        def update(self, v): self.held = v

    class Handle:
        def registerTimer(self, at): made.append(at)

    processor.handle, processor.waiting, processor.entries, processor.count = Handle(), State(), State(), Value()
    import pandas as pd

    for at in range(0, 400, 50):
        part = rows[at : at + 50]
        frame = pd.DataFrame([(i, t, x, v) for _, i, t, x, v in part], columns=["id", "at", "value", "v"])
        list(processor.handleInputRows((1,), iter([frame]), None))
        now = type("T", (), {"getCurrentWatermarkInMs": lambda self, t=part[-1][2] // 1000: t})()
        assert sum(len(f) for f in processor.handleExpiredTimer((1,), now, None)) == 50
        assert len(processor.entries) <= 8 and not processor.waiting
    assert len(made) == 8
