"""Layered navigable graphs: one a shard, built by greedy insertion, stored as adjacency blocks, searched in one Arrow function.

Vectors are dealt to shards of about ``SHARD_ROWS`` by hash of their id. A task inserts its shard's vectors one by one: each draws a top
layer (by a hash, geometric), the search descends greedily to it and keeps, on every layer below, up to ``DEGREE``
links (twice as many on the lowest) to those of the ``BUILD_WIDTH`` nearest found that no kept one is nearer to.
The graph is written in blocks of ``BLOCK`` vectors with their links, as bytes.

A query goes to every shard; there the search descends the layers greedily and widens to ``width`` on the lowest. The
shards' results are merged by a window a query. So a shard's memory is bounded, building needs one shuffle, and recall
does not fall with the number of shards.

Nearness is the inner product. Null or empty vectors, or without id, are in no graph; repeated ids are nodes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace, nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.inverted import asked, matrix
from orrery.operators.vectors import embeddings, recall, top_k
from orrery.sources.scratch import Scratch

#: Vectors of a shard on average, links of a node above the lowest layer, width of the search when building and when asked, vectors of a block.
SHARD_ROWS, DEGREE, BUILD_WIDTH, WIDTH, BLOCK = 4096, 12, 64, 64, 1024
STORED = "shard long, block int, entry int, ids binary, vectors binary, links binary, upper binary"


class Graph:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.lowest = np.full((len(ids), 2 * DEGREE), -1, np.int32)
        self.upper: list[dict[int, np.ndarray]] = []  # by layer, from 1 on: node to links
        self.entry = -1

    def links(self, layer: int, node: int) -> np.ndarray:
        found = self.upper[layer - 1][node] if layer else self.lowest[node]
        return found[found >= 0]

    def link(self, layer: int, node: int, others: list[int]) -> None:
        row = np.full(DEGREE if layer else 2 * DEGREE, -1, np.int32)
        row[: len(others)] = others
        if layer:
            self.upper[layer - 1][node] = row
        else:
            self.lowest[node] = row

    def descend(self, q: np.ndarray, node: int, top: int, bottom: int) -> int:
        """The nearest that greedy steps reach on the layers from ``top`` down to above ``bottom``."""
        near = float(self.vectors[node] @ q)
        for layer in range(top, bottom, -1):
            while True:
                others = self.links(layer, node)
                if not len(others):
                    break
                s = self.vectors[others] @ q
                k = int(s.argmax())
                if s[k] <= near:
                    break
                node, near = int(others[k]), float(s[k])
        return node

    def nearest(self, q: np.ndarray, entry: int, width: int, layer: int, seen: np.ndarray) -> list[tuple[float, int]]:
        """Up to ``width`` (nearness, node) of one layer, best first. seen: marks of the nodes, all unset; unset again at the end."""
        s = float(self.vectors[entry] @ q)
        todo, best, marked = [(-s, entry)], [(s, -entry)], [np.array([entry])]
        seen[entry] = True
        while todo:
            far, node = heappop(todo)
            if len(best) == width and -far < best[0][0]:
                break
            others = self.links(layer, node)
            others = others[~seen[others]]
            if not len(others):
                continue
            seen[others] = True
            marked.append(others)
            for x, o in zip((self.vectors[others] @ q).tolist(), others.tolist(), strict=True):
                if len(best) < width:
                    heappush(best, (x, -o))
                elif x > best[0][0]:
                    heapreplace(best, (x, -o))
                else:
                    continue
                heappush(todo, (-x, o))
        for m in marked:
            seen[m] = False
        return [(x, -o) for x, o in sorted(best, reverse=True)]

    def chosen(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of (nearness, node), best first: those that no chosen one is nearer to; the rest fill up."""
        nodes = [o for _, o in near]
        among = self.vectors[nodes] @ self.vectors[nodes].T
        kept, rest = [], []
        for i, (x, _) in enumerate(near):
            (rest if kept and among[i, kept].max() > x else kept).append(i)
        return [nodes[i] for i in (kept + rest)[:most]]

    def build(self, layers: np.ndarray) -> None:
        """Inserts all nodes in order; layers: each one's top layer."""
        seen, top = np.zeros(len(self.ids), bool), -1
        for node, own in enumerate(layers.tolist()):
            q = self.vectors[node]
            while len(self.upper) < own:
                self.upper.append({})
            for layer in range(own + 1):
                self.link(layer, node, [])
            if self.entry >= 0:
                at = self.descend(q, self.entry, top, min(own, top))
                for layer in range(min(own, top), -1, -1):
                    near = self.nearest(q, at, BUILD_WIDTH, layer, seen)
                    at = near[0][1]
                    others, most = self.chosen(near, DEGREE), DEGREE if layer else 2 * DEGREE
                    self.link(layer, node, others)
                    for o in others:
                        back = [*self.links(layer, o).tolist(), node]
                        if len(back) > most:
                            s = self.vectors[back] @ self.vectors[o]
                            back = self.chosen(sorted(zip(s.tolist(), back, strict=True), key=lambda x: (-x[0], x[1])), most)
                        self.link(layer, o, back)
            if own > top:
                self.entry, top = node, own

    def search(self, q: np.ndarray, width: int, seen: np.ndarray) -> list[tuple[float, int]]:
        return self.nearest(q, self.descend(q, self.entry, len(self.upper), 0), width, 0, seen)

    def blocks(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The graph as rows (STORED)."""
        for at in range(0, len(self.ids), BLOCK):
            end = min(at + BLOCK, len(self.ids))
            high = [np.concatenate([[layer, node], row]) for layer, nodes in enumerate(self.upper, 1) for node, row in nodes.items() if at <= node < end]
            upper = np.array(high, "<i4").tobytes()
            values = (shard, at // BLOCK, self.entry, self.ids[at:end].astype("<i8").tobytes(), self.vectors[at:end].astype("<f4").tobytes(), self.lowest[at:end].astype("<i4").tobytes(), upper)
            columns = [pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in STORED.split(", ")])

    @classmethod
    def of(cls, rows: list[dict]) -> Graph:
        """From a shard's rows in the order of their blocks."""
        ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<i8")
        g = cls(ids, np.frombuffer(b"".join(r["vectors"] for r in rows), "<f4").reshape(len(ids), -1).astype(float))
        g.lowest = np.frombuffer(b"".join(r["links"] for r in rows), "<i4").reshape(len(ids), -1)
        for row in np.frombuffer(b"".join(r["upper"] for r in rows), "<i4").reshape(-1, DEGREE + 2):
            while len(g.upper) < row[0]:
                g.upper.append({})
            g.upper[row[0] - 1][int(row[1])] = row[2:]
        g.entry = rows[0]["entry"]
        return g


def layers_of(ids: np.ndarray) -> np.ndarray:
    """Each id's top layer, by a hash: every layer holds a DEGREE-th of the one below."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(float) / 2**53
    return np.floor(-np.log(np.maximum(u, 1e-16)) / np.log(DEGREE)).astype(int)


def write_graph(vectors: DataFrame, path: str, shards: int | None = None) -> None:
    """The graphs of vectors (id, v), one row a block."""
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where("v is not null and size(v) > 0 and id is not null")
    if shards is None:
        shards = max(1, round(rows.count() / SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("id", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                g = Graph(ids, vectors)
                g.build(layers_of(ids))
                yield from g.blocks(at)

        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(2).to_numpy()
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if shard[lo] != at:
                    yield from done()
                    at, held = int(shard[lo]), []
                held.append((b.column(0).to_numpy()[lo:hi], matrix(b.column(1).slice(lo, hi - lo))))
        yield from done()

    dealt.mapInArrow(run, STORED).write.parquet(path)


def search_graph(spark: SparkSession, path: str, queries: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """(qid, rank, doc_id, score) for queries (id, v); an id is not its own result."""
    blocks = spark.read.schema(STORED).parquet(path)
    shards = blocks.select("shard").distinct()
    null = F.lit(None)
    none = [null.cast(t).alias(c) for c, t in (x.split(" ") for x in STORED.split(", ")[1:])]
    # a query goes to each shard, as in exact search it goes to each column of the grid
    names = shards.agg(F.collect_list("shard").alias("shards"))  # one number for SHARD_ROWS vectors
    asks = queries.select("id", F.col("v").cast("array<double>").alias("v")).join(F.broadcast(names)).select(F.explode("shards").alias("shard"), *none, "id", "v")
    dealt = blocks.select("*", null.cast("long").alias("id"), null.cast("array<double>").alias("v")).union(asks).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_last("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, graph, seen = None, [], None, None
        for b in batches:
            found = []
            for r in b.to_pylist():
                if r["shard"] != at:
                    at, rows, graph = r["shard"], [], None
                if r["block"] is not None:
                    rows.append(r)
                    continue
                if graph is None:
                    graph = Graph.of(rows)
                    rows, seen = [], np.zeros(len(graph.ids), bool)
                best = [(x, int(graph.ids[o])) for x, o in graph.search(np.array(r["v"]), max(width, k + 1), seen)]
                found += [(r["id"], o, x) for x, o in nlargest(k, ((round(x, 9), -o) for x, o in best if o != r["id"])) for o in (-o,)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["qid", "doc_id", "s"])

    hits = dealt.mapInArrow(run, "qid long, doc_id long, s double")
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "doc_id"))
    return hits.withColumn("rank", r).where(F.col("rank") <= k).select("qid", "rank", "doc_id", F.round("s", 6).alias("score"))


def q_graph_knn(spark, d):
    """Recall of the search over graphs that are written and read again."""
    e, k = embeddings(spark, d), 5
    with Scratch(spark) as s:
        path = s.path("graph")
        write_graph(e, path)
        found = recall(top_k(asked(e), e, k, "ip", same=True), search_graph(spark, path, asked(e), k), k)
        return s.kept(found.withColumn("useful", F.col("recall") >= 0.9))


QUERIES = {"graph_knn": q_graph_knn}
ORACLE_SQL = {}
