"""Proximity cache: a query is answered by a stored one within a tolerance (L2), under FIFO or LRU eviction.

State is order-dependent, so a cache is one sequence: queries are keyed (by user, session, or hash
bucket of the vector) and each key's cache runs by itself, in order of time; many keys make it parallel.
Eviction bounds a key's state; its rows are streamed through it batch by batch.
"""

from __future__ import annotations

import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.vectors import neighbours
from orrery.sources.tables import table

POLICIES = ("fifo", "lru", "lsh_fifo", "lsh_lru")
#: Projections whose signs name an LSH policy's bucket.
BUCKET_BITS, BUCKET_SEED = 4, 5


class ProximityCache:
    """The nearest stored key within ``tolerance`` answers; ties go to the oldest. A bucket's size never exceeds ``capacity``.

    fifo and lru have one bucket; lsh_fifo and lsh_lru have one for each pattern of signs of seeded
    projections, each with a capacity of its own, and look no further than the key's.
    """

    def __init__(self, capacity: int, tolerance: float, policy: str = "fifo", bits: int = BUCKET_BITS) -> None:
        if capacity <= 0 or tolerance < 0 or policy not in POLICIES:
            raise ValueError(f"capacity {capacity}, tolerance {tolerance}, policy {policy!r}")
        self.capacity, self.tolerance, self.policy, self.bits = capacity, tolerance, policy, bits
        self.buckets: dict[int, OrderedDict[int, tuple[np.ndarray, object]]] = {}
        self.planes: np.ndarray | None = None
        self.made = self.hits = self.misses = 0

    @property
    def held(self) -> OrderedDict[int, tuple[np.ndarray, object]]:
        """All that is stored, by the order of insertion in each bucket."""
        return OrderedDict(x for b in self.buckets.values() for x in b.items())

    def bucket(self, key: np.ndarray) -> OrderedDict[int, tuple[np.ndarray, object]]:
        name = 0
        if self.policy.startswith("lsh"):
            if self.planes is None:
                self.planes = np.random.default_rng(BUCKET_SEED).normal(size=(self.bits, len(key)))
            name = int(((self.planes @ key >= 0) << np.arange(self.bits)).sum())
        return self.buckets.setdefault(name, OrderedDict())

    def find(self, key: np.ndarray):
        """The stored value, or None."""
        best, held = None, self.bucket(key)
        if held:
            names = list(held)
            dist = np.sqrt(((np.stack([held[n][0] for n in names]) - key) ** 2).sum(1))
            k = min(range(len(names)), key=lambda i: (dist[i], names[i]))
            if dist[k] <= self.tolerance:
                best = names[k]
        if best is None:
            self.misses += 1
            return None
        self.hits += 1
        if self.policy.endswith("lru"):
            held.move_to_end(best)
        return held[best][1]

    def insert(self, key: np.ndarray, value) -> None:
        held = self.bucket(key)
        while len(held) >= self.capacity:
            held.popitem(last=False)
        held[self.made] = (key, value)
        self.made += 1

    def find_batch(self, keys: list[np.ndarray]) -> list:
        """Looks the whole batch up before anything is inserted, so repeats inside a batch all miss."""
        return [self.find(k) for k in keys]

    def read_through(self, keys: list[np.ndarray], fetch: Callable[[list[int]], list]) -> list:
        """Answers a batch: hits from the cache, the misses by one ``fetch`` of their places, which are then stored; in the batch's order."""
        found = self.find_batch(keys)
        missed = [i for i, f in enumerate(found) if f is None]
        for i, value in zip(missed, fetch(missed) if missed else [], strict=True):
            self.insert(keys[i], value)
            found[i] = value
        return found


def signs(v: str, bits: int, dim: int, seed: int = 5):
    """Bucket of a vector: the signs of ``bits`` seeded projections, as a number."""
    planes = np.random.default_rng(seed).normal(size=(bits, dim)).tolist()
    terms = [F.when(F.aggregate(F.zip_with(v, F.array(*map(F.lit, p)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x) >= 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def replay(queries: DataFrame, capacity: int, tolerance: float, policy: str) -> DataFrame:
    """(key, seq, id, hit, source): queries (key, seq, id, v) through their key's cache; source: whose result answers."""
    dealt = queries.repartition("key").sortWithinPartitions("key", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cache = object(), None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["key"] != at:
                    at, cache = row["key"], ProximityCache(capacity, tolerance, policy)
                v = np.asarray(row["v"], float)
                found = cache.find(v)
                if found is None:
                    cache.insert(v, row["id"])
                out.append((row["key"], row["seq"], row["id"], found is not None, row["id"] if found is None else found))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("key", "seq", "id", "hit", "source"), map(list, zip(*out, strict=True)), strict=True)))

    return dealt.mapInArrow(run, "key long, seq long, id long, hit boolean, source long")


class FifoSweep:
    """FIFO caches of one capacity, a tolerance each, that see the same keys: distances to all that any of them stores are worked out once a key.

    Places of stored keys are reused when no cache holds them, so that there are ``capacity`` places a cache at most.
    """

    def __init__(self, capacity: int, tolerances: tuple[float, ...], dim: int) -> None:
        if capacity <= 0 or min(tolerances) < 0:
            raise ValueError(f"capacity {capacity}, tolerances {tolerances}")
        self.capacity, self.tolerances = capacity, tolerances
        places = capacity * len(tolerances)
        self.keys, self.users = np.zeros((places, dim)), [0] * places
        self.held: list[deque[int]] = [deque() for _ in tolerances]
        self.free, self.top = list(range(places - 1, -1, -1)), 0  # places from ``top`` on were never used
        self.inside = np.zeros((len(tolerances), places), bool)

    def see(self, key: np.ndarray) -> list[bool]:
        """Of each cache whether it answers; those that don't store the key."""
        hits = [False] * len(self.held)
        if self.top:
            dist = np.sqrt(((self.keys[: self.top] - key) ** 2).sum(1))
            hits = [bool((dist[own[: self.top]] <= t).any()) for own, t in zip(self.inside, self.tolerances, strict=True)]
        missed = [c for c, hit in enumerate(hits) if not hit]
        for c in missed:
            if len(self.held[c]) == self.capacity:
                gone = self.held[c].popleft()
                self.inside[c, gone] = False
                self.users[gone] -= 1
                if not self.users[gone]:
                    self.free.append(gone)
        if missed:
            place = self.free.pop()
            self.keys[place], self.users[place], self.top = key, len(missed), max(self.top, place + 1)
            for c in missed:
                self.inside[c, place] = True
                self.held[c].append(place)
        return hits


def sweep(queries: DataFrame, capacity: int, tolerances: tuple[float, ...]) -> DataFrame:
    """(tolerance, queries, hits): queries (key, seq, v) through FIFO caches of every tolerance in one pass."""
    dealt = queries.select("key", "seq", "v").repartition("key").sortWithinPartitions("key", "seq")
    names = [f"h{c}" for c in range(len(tolerances))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, caches, n, hits = None, None, 0, np.zeros(len(tolerances), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for key, v in zip(b.column("key").to_pylist(), x, strict=True):
                if caches is None or key != at:
                    at, caches = key, FifoSweep(capacity, tolerances, x.shape[1])
                hits += caches.see(v)
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"queries": [n], **{c: [h] for c, h in zip(names, hits.tolist(), strict=True)}})

    found = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ("queries", *names)))
    one = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("queries", *names)))
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("tolerance"), F.col("queries"), F.col(c).alias("hits")) for t, c in zip(tolerances, names, strict=True))))
    return one.select(each.alias("x")).select("x.*")


def stream(spark, d: str) -> DataFrame:
    """Each event asks with the vector of its id; the event's user is the key."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("vec_id"))
    q = e.join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")), "vec_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return q.select(F.col("user_id").alias("key"), seq.cast("long").alias("seq"), F.col("vec_id").alias("id"), "v")


def _rates(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


def q_fifo(spark, d):
    return replay(stream(spark, d), 16, 0.0, "fifo").select("key", "seq", "id", "hit")


def q_lru(spark, d):
    return replay(stream(spark, d), 16, 0.0, "lru").select("key", "seq", "id", "hit")


def q_tolerance_sweep(spark, d):
    """Four tolerances in one pass over the events."""
    rates = sweep(stream(spark, d), 32, (0.0, 0.5, 1.0, 1.2))
    return rates.select("tolerance", "queries", "hits", F.when(F.col("queries") > 0, F.round(F.col("hits") / F.col("queries"), 6)).alias("hit_rate"))


def q_lsh_cache(spark, d):
    """Keys by the signs of projections instead of users."""
    s = stream(spark, d)
    s = s.withColumn("key", signs("v", 4, 64).cast("long"))
    s = s.withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("seq", "id")).cast("long"))
    return _rates(replay(s, 64, 1.0, "lru"))


def q_unbounded_cache(spark, d):
    """With room for all and tolerance 0, a hit is a repeat: the same in SQL."""
    r = replay(stream(spark, d), 1 << 30, 0.0, "fifo")
    return r.groupBy("key").agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"))


def q_lsh_policy(spark, d):
    """The cache's own LSH buckets, of 8 keys each, under LRU."""
    return _rates(replay(stream(spark, d), 8, 1.0, "lsh_lru"))


def q_hit_overlap(spark, d):
    """Of cache hits under a wide tolerance: the share of the true five nearest that the answering query's five have, and rates."""
    r = replay(stream(spark, d), 32, 1.2, "lru").select("id", "hit", "source")
    n = neighbours(spark, d, 5).groupBy("qid").agg(F.collect_set("doc_id").alias("ids"))
    hits = r.where("hit").join(n.select(F.col("qid").alias("id"), F.col("ids").alias("truth")), "id").join(n.select(F.col("qid").alias("source"), F.col("ids").alias("given")), "source")
    rates = _rates(r)
    return rates.join(hits.agg(F.round(F.avg(F.size(F.array_intersect("truth", "given")) / 5), 6).alias("overlap")), F.lit(True))


def timed_replay(queries: DataFrame, truth: Callable[[], DataFrame], capacity: int, tolerance: float, policy: str) -> dict[str, float]:
    """Queries, hits, seconds and queries a second of a replay, with the exact search of every query and without."""
    began = time.perf_counter()
    row = _rates(replay(queries, capacity, tolerance, policy)).first()
    mid = time.perf_counter()
    truth().write.format("noop").mode("overwrite").save()
    end = time.perf_counter()
    return {"queries": row["queries"], "hits": row["hits"], "seconds": mid - began, "qps": row["queries"] / (mid - began), "qps_with_truth": row["queries"] / (end - began)}


QUERIES = {
    "proximity_cache_fifo": q_fifo, "proximity_cache_lru": q_lru, "cache_tolerance_sweep": q_tolerance_sweep, "cache_lsh_keys": q_lsh_cache, "cache_unbounded": q_unbounded_cache, "cache_lsh_policy": q_lsh_policy, "cache_hit_overlap": q_hit_overlap,
}
ORACLE_SQL = {
    # with tolerance 0, FIFO answers if the vector is among the sixteen that were stored last
    "proximity_cache_fifo": """with recursive q as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) as seq, vec_id as id, md5(embedding::varchar) as v from events join embeddings on vec_id = (props::json ->> '$.k')::bigint),
w as (select key, seq, id, [v] as held, false as hit from q where seq = 1
      union all select q.key, q.seq, q.id, case when list_contains(w.held, q.v) then w.held else list_append(w.held, q.v)[-16:] end, list_contains(w.held, q.v) from w join q on q.key = w.key and q.seq = w.seq + 1)
select key, seq, id, hit from w""",
    # with tolerance 0, LRU answers if fewer than 16 other vectors were asked for since the last time
    "proximity_cache_lru": """with q as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) as seq, vec_id as id, embedding::varchar as v from events join embeddings on vec_id = (props::json ->> '$.k')::bigint),
l as (select *, lag(seq) over (partition by key, v order by seq) as last from q)
select key, seq, id, last is not null and (select count(distinct b.v) from q b where b.key = l.key and b.seq > l.last and b.seq < l.seq) < 16 as hit from l""",
    "cache_unbounded": "with q as (select user_id as key, (props::json ->> '$.k')::bigint as id from events), k as (select key, id, count(*) as n from q join embeddings on vec_id = id group by all) select key, sum(n)::bigint as queries, (sum(n) - count(*))::bigint as hits from k group by key",
}
