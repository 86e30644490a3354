"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are range-sorted by length, longest first, and packed into buckets of similar length.
Queries are packed into blocks. Blocks and buckets meet in the cells of a grid: a block goes to every
column, a bucket to every row, and a cell keeps its blocks and takes its buckets longest first, so that
each query's k-th best score so far, theta, rises early. In a bucket whose longest vector is l, a query
q needs a cosine of at least theta / (|q| l), the local threshold:

- above 1, the bucket is passed over whole;
- from ``COORDINATE_COSINE`` on, the query's ``FOCUS`` largest coordinates each bound the candidates'
  normalised coordinate to an interval, and only vectors inside all of them remain;
- below, the candidates at least theta / |q| long remain, a prefix of the bucket.

What remains is verified by whole-number inner products. Pruning keeps ties, and rounding is allowed
for, so the result is exact: floating point holds every product and sum where |q| l stays under 2**53,
and whole numbers of any size are used where it does not. A score that a long cannot hold counts as the
nearest long.

Null vectors, empty ones and those with null or non-finite components take no part. Vectors of
another dimension are not scored against a query. Null ids take no part. Repeated ids are candidates each for itself
(none against its own id). Empty table: no rows. Any finite component will do, if
256 times it is finite too.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import common

#: Vectors in a bucket and queries in a block; buckets in a column and blocks in a row of the grid.
BUCKET_ROWS, BLOCK_ROWS, COLUMN_BUCKETS, ROW_BLOCKS = 1024, 512, 8, 8
#: Local cosine threshold from which coordinates prune, and the coordinates looked at.
COORDINATE_COSINE, FOCUS = 0.4, 4
#: Lengths' product under which floating point is exact: no sum of products leaves the whole numbers that it holds.
EXACT = 2.0**53

PACKED = "kind int, place long, dim int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def packed(rows: DataFrame, kind: int, size: int) -> DataFrame:
    """Rows (id, v) of each partition, in its order, as pieces of at most ``size`` vectors of one dimension (PACKED), longest first in a piece.

    Components are rounded down to whole numbers; a piece holds them in 4 bytes each if all fit, else as doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def piece(dim: int, n: int) -> pa.RecordBatch:
            nonlocal place
            ids, vectors = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
            waiting[dim] = [(ids[n:], vectors[n:])]
            place += 1
            ids, vectors = ids[:n], vectors[:n]
            order = np.lexsort((ids, -lengths(vectors)))
            kept = vectors[order].astype("<i4" if np.abs(vectors).max() < 2**31 else "<f8")
            return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "place": [place], "dim": pa.array([dim], pa.int32()), "ids": [ids[order].tobytes()], "vectors": [kept.tobytes()]})

        for b in batches:
            ids, lists = b.column("id").to_numpy(), b.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            ends = np.append(0, np.cumsum(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                vectors = np.floor(flat[ends[at][:, None] + np.arange(dim)].astype("<f8"))
                waiting.setdefault(dim, []).append((ids[at].astype("<i8"), vectors))
                while sum(len(x) for x, _ in waiting[dim]) >= size:
                    yield piece(dim, size)
        for dim in list(waiting):
            if n := sum(len(x) for x, _ in waiting[dim]):
                yield piece(dim, n)

    return rows.select("id", "v").mapInArrow(run, PACKED)


def unpacked(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(vectors, "<i4" if len(vectors) == 4 * dim * len(found) else "<f8").reshape(-1, dim).astype(np.float64)


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths; scaled first, so that no square overflows."""
    top = np.abs(vectors).max(1, initial=0.0)
    scaled = vectors / np.where(top > 0, top, 1.0)[:, None]
    with np.errstate(over="ignore"):
        return top * np.sqrt((scaled * scaled).sum(1))


class Best:
    """The k best (score, id) of each query of a block: higher scores first, smaller ids among equals.

    Scores are floating point while that is exact, and Python's whole numbers (``wide``) from the first bucket
    on for which it may not be.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.length = lengths(vectors)
        unit = vectors / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        self.focal = np.take_along_axis(unit, self.focus, 1)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.wide: list[list[tuple[int, int]]] | None = None  # of each query: (-score, id), best first

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of all that is held."""
        if self.wide is None:
            q, r = np.nonzero(~np.isneginf(self.score))
            return self.ids[q], self.found[q, r], self.score[q, r].astype(np.int64)
        rows = [(q, i, -s) for q, held in zip(self.ids.tolist(), self.wide, strict=True) for s, i in held]
        return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows of scores and ids for the queries ``q``; -inf where there is none."""
        scores = np.hstack([self.score[q], scores])
        ids = np.hstack([self.found[q], np.broadcast_to(ids, (len(q), scores.shape[1] - self.k))])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.score[q], self.found[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def search_wide(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray) -> None:
        """One bucket in whole numbers: length pruning, then exact products."""
        if self.wide is None:
            self.wide = [[(-int(s), i) for s, i in zip(score, found, strict=True) if s > -np.inf] for score, found in zip(self.score.tolist(), self.found.tolist(), strict=True)]
        whole = [list(map(int, v)) for v in vectors.tolist()]
        for best, own, query, size in zip(self.wide, self.ids.tolist(), self.vectors.tolist(), self.length.tolist(), strict=True):
            q = list(map(int, query))
            for i, v, reach in zip(ids.tolist(), whole, (size * length * (1 + 1e-9)).tolist(), strict=True):
                if len(best) == self.k and -best[-1][0] > reach:
                    break  # those after it are no longer
                if i != own:
                    insort(best, (-max(-(2**63), min(2**63 - 1, sum(map(mul, q, v)))), i))
                    del best[self.k :]

    def search(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray, unit: np.ndarray) -> None:
        """One bucket, its vectors longest first."""
        if self.wide is not None or not self.length.max() * length[0] < EXACT:
            return self.search_wide(ids, vectors, length)
        theta = self.score[:, -1]
        reach = self.length * length[0]
        none = np.isneginf(theta)
        local = np.where(none | (theta <= 0), -1.0, theta / np.maximum(reach, 1e-300)) - 1e-9
        by_coordinate = (local >= COORDINATE_COSINE) & (local <= 1)
        rest = np.flatnonzero(~by_coordinate & (local <= 1))
        if rest.size:
            need = np.where(theta[rest] > 0, theta[rest] / np.maximum(self.length[rest], 1e-300), 0.0) * (1 - 1e-9) - 1e-6
            n = int(np.searchsorted(-length, -need.min(), side="right"))
            scores = self.vectors[rest] @ vectors[:n].T
            self.offer(rest, np.where(self.ids[rest][:, None] == ids[None, :n], -np.inf, scores), ids[None, :n])
        for q in np.flatnonzero(by_coordinate).tolist():
            t, inside = local[q], None
            for f, x in zip(self.focus[q].tolist(), self.focal[q].tolist(), strict=True):
                slack = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                column = unit[:, f] if inside is None else unit[inside, f]
                ok = (column >= x * t - slack) if x > 0 else (column <= x * t + slack)
                if abs(x) <= t:  # the axis lies outside the cap, so the interval closes on the other side too
                    ok &= np.abs(column - x * t) <= slack
                inside = np.flatnonzero(ok) if inside is None else inside[ok]
            if inside.size:
                scores = vectors[inside] @ self.vectors[q]
                good = (scores >= theta[q]) & (ids[inside] != self.ids[q])
                if good.any():
                    self.offer(np.array([q]), scores[good][None, :], ids[inside][good][None, :])


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (id, v: array of numbers) of both sides, components rounded down; an id is never its own result."""
    spark = candidates.sparkSession
    common.text_batches(spark)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, m = candidates.count(), queries.count()
    parts = max(1, -(-n // (BUCKET_ROWS * COLUMN_BUCKETS)))
    lengths_of = candidates.withColumn("_l", length)
    buckets = packed(lengths_of.repartitionByRange(parts, F.desc("_l"), F.asc("id")).sortWithinPartitions(F.desc("_l"), F.asc("id")), 1, BUCKET_ROWS)
    columns, rows = max(1, n // (BUCKET_ROWS * COLUMN_BUCKETS)), max(1, m // (BLOCK_ROWS * ROW_BLOCKS))
    blocks = packed(queries.repartition(max(1, -(-m // BLOCK_ROWS)), "id"), 0, BLOCK_ROWS)
    row, column = F.pmod(F.xxhash64("place"), F.lit(rows)), F.pmod(F.xxhash64("place"), F.lit(columns))
    cells = blocks.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: row * columns + c)))
    cells = cells.union(buckets.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * columns + column))))
    dealt = cells.repartition(columns * rows, "cell").sortWithinPartitions("cell", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}

        def result() -> Iterator[pa.RecordBatch]:
            for best in (b for blocks in held.values() for b in blocks):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, best.results())), ["query_id", "vec_id", "score"])

        for at, kinds, dims, ids, vectors in common.rows_of(batches, "cell", "kind", "dim", "ids", "vectors"):
            for c, kind, dim, i, v in zip(at, kinds, dims, ids, vectors, strict=True):
                if c != cell:
                    yield from result()
                    cell, held = c, {}
                i, v = unpacked(i, v, dim)
                if kind == 0:
                    held.setdefault(dim, []).append(Best(i, v, k))
                elif dim in held:
                    size = lengths(v)
                    for best in held[dim]:
                        best.search(i, v, size, v / np.maximum(size, 1e-300)[:, None])
        yield from result()

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_norm_buckets(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256)
    rows = common.stored(rows.select(F.col("vec_id").alias("id"), scaled.alias("v")), "vectors")
    return top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


QUERIES = {"op10_norm_buckets": op10_norm_buckets}
ORACLE_SQL = {
    "op10_norm_buckets": """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1]::hugeint * z[2]::hugeint))::bigint as score
      from e as q join e on q.vec_id <> e.vec_id and len(q.v) = len(e.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5"""
}
