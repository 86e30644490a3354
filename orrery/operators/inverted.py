"""Inverted lists on disk: full vectors and product-quantised residuals in one folder a list.

``write_index`` trains list centroids (about the root of the count) and codebooks on a bounded sample and writes every
vector into the ``COPIES`` lists nearest to it, with the code of its residual in each: one byte a part. Centroids are
searched by the exact grid of blocks, so nothing is broadcast that grows with the data.

A search ranks the lists for each query and reads the folders of the probed lists alone: Spark prunes them while the
query runs, by the join with the probed lists. ``search_vectors`` multiplies queries with the lists' full vectors;
``search_codes`` adds up entries of each query's distance tables by the stored bytes, no vector is decoded, and
multiplies the full vectors of a few proposed ids afterwards. A long list is cut into pieces; its queries go to each.

Vectors that are null, empty or without id are in no list. Equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.vectors import embeddings, recall, top_k
from orrery.sources.scratch import Scratch

#: Lists a vector is in, share of the lists that a query reads and the fewest, bytes of a code, values of a byte that are used.
COPIES, PROBED, FEWEST, PARTS, CODES = 4, 0.25, 8, 16, 256
#: Vectors that train centroids, and residuals that train codebooks, at most; every vector is indexed.
TRAIN_ROWS, BOOK_ROWS = 100_000, 10_000
#: Vectors in a piece of a list; ids that codes propose for each result asked for.
PIECE, WIDER = 4096, 10
#: Lists that are broadcast by number at most; beyond it the join shuffles.
FEW_LISTS = 200_000


def sampled(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("id")).limit(most)


def trained_centroids(vectors: DataFrame, lists: int, seed: int = 1) -> DataFrame:
    """(id, v): the lists' numbers and centroids."""
    x = sampled(vectors, TRAIN_ROWS).select(array_to_vector("v").alias("features"))
    centers = KMeans(k=lists, seed=seed, maxIter=10).fit(x).clusterCenters()
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "id long, v array<double>")


def trained_codebooks(sample: np.ndarray, parts: int = PARTS, codes: int = CODES, seed: int = 3) -> np.ndarray:
    """parts x codes x width values by Lloyd's iterations; the dimension must divide by ``parts``."""
    n, dim = sample.shape
    if dim % parts:
        raise ValueError(f"{dim} dimensions do not divide into {parts} parts")
    rng = np.random.default_rng(seed)
    out = np.zeros((parts, codes, dim // parts))
    for p, book in enumerate(out):
        x = sample[:, p * (dim // parts) : (p + 1) * (dim // parts)]
        book[:] = x[rng.choice(n, codes, replace=n < codes)]
        for _ in range(8):
            near = ((book * book).sum(1)[None, :] - 2 * x @ book.T).argmin(1)
            count = np.bincount(near, minlength=codes)
            total = np.stack([np.bincount(near, x[:, w], codes) for w in range(x.shape[1])], 1)
            book[count > 0] = total[count > 0] / count[count > 0, None]
    return out


def codes_of(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    """One byte a part."""
    x = residuals.reshape(len(residuals), len(books), -1)
    return np.stack([((b * b).sum(1)[None, :] - 2 * x[:, p] @ b.T).argmin(1) for p, b in enumerate(books)], 1).astype(np.uint8)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def write_index(vectors: DataFrame, path: str, lists: int | None = None, copies: int = COPIES, parts: int = PARTS) -> None:
    """Vectors (id, v) as ``path``/lists/list=…, with ``path``/centroids and ``path``/codebooks."""
    spark = vectors.sparkSession
    vectors = vectors.select("id", "v").where("v is not null and size(v) > 0 and id is not null")
    if lists is None:
        lists = max(1, round(vectors.count() ** 0.5))
    trained_centroids(vectors, lists).write.parquet(f"{path}/centroids")
    centroids = spark.read.parquet(f"{path}/centroids")
    own = top_k(vectors, centroids, copies, "l2").select(F.col("qid").alias("id"), F.col("doc_id").alias("list"))
    placed = own.join(vectors, "id").join(centroids.select(F.col("id").alias("list"), F.col("v").alias("c")), "list")
    placed = placed.select("list", "id", F.transform("v", lambda x: x.cast("float")).alias("v"), F.zip_with("v", "c", lambda a, b: a - b).alias("residual"))
    with Scratch(spark) as s:
        placed = s.stored(placed, "placed")
        sample = np.array([r[0] for r in sampled(placed, BOOK_ROWS).select("residual").collect()], float)
        books = trained_codebooks(sample, parts)
        spark.createDataFrame([(p, b.astype("<f8").tobytes()) for p, b in enumerate(books)], "part int, data binary").write.parquet(f"{path}/codebooks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    code = codes_of(matrix(b.column(3)), books)
                    yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c.tobytes() for c in code], pa.binary())], ["list", "id", "v", "code"])

        coded = placed.mapInArrow(run, "list long, id long, v array<float>, code binary")
        coded.repartition("list").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/lists")


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(id, v, code, list): the stored index."""
    return spark.read.schema("id long, v array<float>, code binary, list long").parquet(f"{path}/lists")


def probed(spark: SparkSession, path: str, queries: DataFrame, nprobe: int) -> DataFrame:
    """(qid, list, base): the lists to read for each query, and its product with their centroids."""
    found = top_k(queries.select("id", "v"), spark.read.parquet(f"{path}/centroids"), nprobe, "ip")
    return found.select("qid", F.col("doc_id").alias("list"), F.col("score").alias("base"), "rank")


def list_rows(spark: SparkSession, path: str, probes: DataFrame, nprobe: int) -> DataFrame:
    """The rows of the probed lists; other lists' folders are not read."""
    wanted = probes.where(F.col("rank") <= nprobe).select("list").distinct()
    lists = read_lists(spark, path)
    few = spark.read.parquet(f"{path}/centroids").count() <= FEW_LISTS
    return lists.join(F.broadcast(wanted) if few else wanted, "list", "left_semi")


def dealt(rows: DataFrame, probes: DataFrame, queries: DataFrame, column: str) -> DataFrame:
    """(cell, side, id, stored, v, base): pieces of lists (side 0), each followed by the queries that probe its list."""
    stored_ = rows.select("list", "id", F.col(column).alias("stored"))
    pieces = stored_.groupBy("list").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    null = F.lit(None)
    own = stored_.join(pieces, "list").select("list", F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece"), F.lit(0).alias("side"), "id", "stored", null.cast("array<double>").alias("v"), null.cast("double").alias("base"))
    asks = probes.select("qid", "list", "base").join(queries.select(F.col("id").alias("qid"), F.col("v").cast("array<double>").alias("v")), "qid").join(pieces, "list")
    asks = asks.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("side"), F.col("qid").alias("id"), null.cast(stored_.schema["stored"].dataType).alias("stored"), "v", "base")
    cells = own.union(asks).withColumn("cell", F.xxhash64("list", "piece"))
    return cells.select("cell", "side", "id", "stored", "v", "base").repartition("cell").sortWithinPartitions("cell", "side")


def best_of(cells: DataFrame, k: int, read, score) -> DataFrame:
    """(qid, doc_id, s) the k best of each query in each cell; read: stored column to matrix; score: (matrix, queries, bases) to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            at, side, ids = (b.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if at[lo] != cell:
                    cell, held = at[lo], []
                part = b.slice(lo, hi - lo)
                if side[lo] == 0:
                    held.append((ids[lo:hi], read(part.column(3))))
                    continue
                if not held:
                    continue
                held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                names, rows = held[0]
                for q in range(0, hi - lo, 256):
                    own = ids[lo:hi][q : q + 256]
                    s = np.round(score(rows, matrix(part.column(4).slice(q, len(own))), part.column(5).to_numpy(zero_copy_only=False)[q : q + 256]), 9)
                    s[own[:, None] == names[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :k]
                    value = np.take_along_axis(s, order, 1)
                    r, j = np.nonzero(np.isfinite(value))
                    yield pa.RecordBatch.from_pydict({"qid": own[r], "doc_id": names[order[r, j]], "s": value[r, j]})

    return cells.mapInArrow(run, "qid long, doc_id long, s double")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """A vector that several lists gave counts once."""
    one = hits.groupBy("qid", "doc_id").agg(F.max("s").alias("s"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "doc_id"))
    return one.withColumn("rank", r).where(F.col("rank") <= k)


def search_vectors(spark: SparkSession, path: str, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(qid, rank, doc_id, score) by inner product with the full vectors of the probed lists."""
    probes = probed(spark, path, queries, nprobe)
    cells = dealt(list_rows(spark, path, probes, nprobe), probes, queries, "v")
    return ranked(best_of(cells, k, matrix, lambda rows, q, _: q @ rows.T), k).select("qid", "rank", "doc_id", F.round("s", 6).alias("score"))


def search_codes(spark: SparkSession, path: str, queries: DataFrame, vectors: DataFrame, k: int, nprobe: int, wider: int = WIDER) -> DataFrame:
    """(qid, rank, doc_id, score): the codes propose ``wider`` ids for each result, exact products rank them."""
    books = np.stack([np.frombuffer(r.data, "<f8").reshape(CODES, -1) for r in spark.read.parquet(f"{path}/codebooks").orderBy("part").collect()])
    probes = probed(spark, path, queries, nprobe)

    def read(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)

    def score(codes: np.ndarray, q: np.ndarray, base: np.ndarray) -> np.ndarray:
        tables = np.einsum("qpw,pcw->pqc", q.reshape(len(q), len(books), -1), books)
        s = np.repeat(base[:, None], len(codes), 1)
        for p, t in enumerate(tables):
            s += t[:, codes[:, p]]
        return s

    cells = dealt(list_rows(spark, path, probes, nprobe), probes, queries, "code")
    proposed = ranked(best_of(cells, k * wider, read, score), k * wider).select("qid", "doc_id")
    full = proposed.join(vectors.select(F.col("id").alias("doc_id"), "v"), "doc_id").join(queries.select(F.col("id").alias("qid"), F.col("v").alias("q")), "qid")
    exact = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    return ranked(full.select("qid", "doc_id", F.round(exact, 9).alias("s")), k).select("qid", "rank", "doc_id", F.round("s", 6).alias("score"))


def asked(e: DataFrame) -> DataFrame:
    """The query set of the approximate searches."""
    return e.where(F.col("id") % 100 == 0)


def measured(spark, d: str, search, k: int = 5) -> DataFrame:
    """recall, lists, nprobe (a quarter of the lists, FEWEST at least) and useful (a recall of 0.9) of a search over an index that is written and read again."""
    e = embeddings(spark, d)
    with Scratch(spark) as s:
        path = s.path("index")
        write_index(e, path)
        lists = spark.read.parquet(f"{path}/centroids").count()
        nprobe = min(lists, max(FEWEST, int(lists * PROBED)))
        found = recall(top_k(asked(e), e, k, "ip", same=True), search(spark, path, e, k, nprobe), k)
        return s.kept(found.select("recall", F.lit(lists).alias("lists"), F.lit(nprobe).alias("nprobe"), (F.col("recall") >= 0.9).alias("useful")))


def q_ivf_kmeans(spark, d):
    return measured(spark, d, lambda s, path, e, k, n: search_vectors(s, path, asked(e), k, n))


def q_pq_knn(spark, d):
    return measured(spark, d, lambda s, path, e, k, n: search_codes(s, path, asked(e), e, k, n))


QUERIES = {"ivf_kmeans": q_ivf_kmeans, "pq_knn": q_pq_knn}
ORACLE_SQL = {}
