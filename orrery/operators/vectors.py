"""Vector search: exact (inner product, L2, cosine), inverted lists, scalar and product quantisation.

Exact search is a grid of blocks: queries and corpus are packed into blocks of vectors, a cell of the
grid holds its query blocks with each query's k best so far, multiplies them with one corpus block after
the other as matrices, ranks only products that reach the k-th best, and a window ranks the cells' results. Scores are rounded to 9 digits before they are ranked, so that equal
vectors tie whatever the order of summation; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import Scratch
from orrery.sources.tables import table

#: Vectors in a block; queries, and vectors they meet, of one cell; rows of a product; shares of the queries at most where they are as many as the vectors.
BLOCK, CELL_QUERIES, CELL_CORPUS, ROWS, SHARES = 1024, 65_536, 131_072, 128, 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Divided by the norm plus 1e-12; a zero vector stays zero."""
    n = norm(a) + F.lit(1e-12)
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def _packed(rows: DataFrame, side: int, count: int) -> DataFrame:
    """(side, place, dim, ids, data): blocks of about BLOCK vectors; four bytes a coordinate where the column has no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            dims = np.diff(v.offsets.to_numpy())
            if len(set(dims.tolist())) != 1:
                raise ValueError("vectors of one column must have one dimension")
            flat = v.flatten().to_numpy(zero_copy_only=False)
            flat = flat.astype("<f4" if flat.dtype == np.float32 else "<f8").reshape(-1, dims[0])
            ids = b.column("id").to_numpy().astype("<i8")
            for part, x in zip(np.array_split(ids, n := max(1, round(len(ids) / BLOCK))), np.array_split(flat, n), strict=True):
                yield pa.RecordBatch.from_pydict({"side": pa.array([side], pa.int32()), "place": pa.array([place], pa.int32()), "dim": pa.array([dims[0]], pa.int32()), "ids": [part.tobytes()], "data": [x.tobytes()]})

    rows = rows.where("v is not null and size(v) > 0 and id is not null").select("id", "v").repartition(max(1, -(-count // BLOCK)), "id")
    return rows.mapInArrow(run, "side int, place int, dim int, ids binary, data binary")


#: Rounding of a number of four bytes.
ERROR = 2.0**-24


def shortened(x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(vectors with four bytes a number, their lengths); None where these would be too long for products of four bytes."""
    length = np.sqrt((x * x).sum(1))
    return (x.astype(np.float32) if (length < 1e15).all() else None), length


class Best:
    """The k best of a block of queries among the blocks seen so far.

    Products of four bytes a number choose what is scored with eight: their error is at most ``ERROR`` a coordinate, times both lengths.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> None:
        self.ids, self.k, self.scale = ids, k, 2.0 if metric == "l2" else 1.0
        # -|q - x|^2 = 2 (q, 1)(x, -|x|^2 / 2) - |q|^2
        self.x = np.hstack([x, np.ones((len(x), 1))]) if metric == "l2" else x
        self.shift = -(x * x).sum(1) if metric == "l2" else np.zeros(len(x))
        self.best, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.short, self.length = shortened(self.x)

    def see(self, ids: np.ndarray, x: np.ndarray, same: bool) -> None:
        """Few products reach a query's k-th best score so far: only those are rounded and ranked."""
        short, length = shortened(x)
        both = self.short is not None and short is not None
        mine, other, kind = (self.short, short, np.float32) if both else (self.x, x, np.float64)
        # room for rounding of a product, besides that of the score
        room = self.length * (length.max(initial=0.0) * ERROR * (x.shape[1] + 4)) + 1e-30 if both else np.zeros(len(self.ids))
        products, reach = np.empty((ROWS, len(ids)), kind), np.empty((ROWS, len(ids)), bool)
        for lo in range(0, len(self.ids), ROWS):
            at = slice(lo, lo + ROWS)
            s = np.matmul(mine[at], other.T, out=products[: len(self.ids) - lo])
            least = (self.best[at, -1] - self.shift[at]) / self.scale
            least -= 1e-9 + 1e-14 * np.abs(least)
            if np.isneginf(least).any() and len(ids) > self.k:
                if same:
                    s[self.ids[at, None] == ids[None, :]] = -np.inf
                t = np.partition(s, -self.k, axis=1)[:, -self.k].astype(float)
                least = np.maximum(least, np.where(np.isfinite(t), t - 1e-9 - 1e-14 * np.abs(t) - room[at], -np.inf))
            reached = np.nextafter((least - room[at]).astype(kind), kind(-np.inf)) if both else least
            hit = np.flatnonzero(np.greater_equal(s, reached[:, None], out=reach[: len(s)]))
            r, j = hit // len(ids), hit % len(ids)
            if both:  # many where lengths differ widely
                exact = np.einsum("ij,ij->i", self.x[at][r], x[j]) if 16 * len(hit) < s.size else (self.x[at] @ x.T).ravel()[hit]
                good = np.flatnonzero(exact >= least[r])
                r, j, exact = r[good], j[good], exact[good]
            else:
                exact = s.ravel()[hit]
            score = np.round(self.scale * exact + self.shift[at][r], 9)
            good = np.isfinite(score) & (self.ids[at][r] != ids[j]) if same else np.isfinite(score)
            if good.any():
                self.add(r[good] + lo, score[good], ids[j[good]])

    def add(self, r: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        rows, own = np.unique(r, return_inverse=True)
        own = np.concatenate([np.repeat(np.arange(len(rows)), self.k), own])
        score, names = np.concatenate([self.best[rows].ravel(), score]), np.concatenate([self.found[rows].ravel(), names])
        order = np.lexsort((names, -score, own))
        starts = np.searchsorted(own[order], np.arange(len(rows)))
        first = order[starts[:, None] + np.arange(self.k)]
        self.best[rows], self.found[rows] = score[first], names[first]


def grid(m: int, n: int, cores: int) -> tuple[int, int]:
    """Shares of m queries and of n vectors, whose cells are bounded and keep the cores busy: by queries first, as each cell that a query is in gives k rows of it."""
    rows, columns = max(1, -(-m // CELL_QUERIES)), max(1, -(-n // CELL_CORPUS))
    rows = max(rows, min(-(-m // BLOCK), -(-2 * cores // columns), -(-SHARES * m // max(1, n))))
    return rows, max(columns, min(-(-n // BLOCK), -(-2 * cores // rows)))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", same: bool = False) -> DataFrame:
    """(qid, rank, doc_id, score) for rows (id, v) of both sides. metric: ip, l2 (squared, ascending) or cosine; same: not an id against itself."""
    n, m = corpus.count(), queries.count()
    rows, columns = grid(m, n, corpus.sparkSession.sparkContext.defaultParallelism)
    each = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    q = _packed(queries, 0, m).select("*", each(columns).alias("_at")).withColumn("cell", F.col("place") % rows * columns + F.col("_at"))
    c = _packed(corpus, 1, n).select("*", each(rows).alias("_at")).withColumn("cell", F.col("_at") * columns + F.col("place") % columns)
    dealt = q.union(c).drop("_at", "place").repartitionById(rows * columns, F.col("cell")).sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for h in held:
                r, j = np.nonzero(np.isfinite(h.best))
                yield pa.RecordBatch.from_pydict({"qid": h.ids[r], "doc_id": h.found[r, j], "score": h.best[r, j]})

        for b in batches:
            for at in range(b.num_rows):
                row = {name: b.column(name)[at].as_py() for name in b.schema.names}
                if row["cell"] != cell:
                    yield from done()
                    cell, held = row["cell"], []
                ids = np.frombuffer(row["ids"], "<i8")
                x = np.frombuffer(row["data"], f"<f{len(row['data']) // (len(ids) * row['dim'])}").astype("<f8").reshape(-1, row["dim"])
                if metric == "cosine":
                    x = x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]
                if row["side"] == 0:
                    held.append(Best(ids, x, k, metric))
                    continue
                if metric == "l2":
                    x = np.hstack([x, -(x * x).sum(1)[:, None] / 2])
                for h in held:
                    h.see(ids, x, same)
        yield from done()

    found = dealt.mapInArrow(run, "qid long, doc_id long, score double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    score = -F.col("score") if metric == "l2" else F.col("score")
    return found.select("qid", "rank", "doc_id", F.round(score, 6).alias("score"))


def embeddings(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def neighbours(spark, d: str, k: int, metric: str = "ip") -> DataFrame:
    e = embeddings(spark, d)
    return top_k(e, e, k, metric, same=True)


def q_knn_exact_ip(spark, d):
    """Top 10 by inner product, with the passage of each hit (inner join: hits without a passage go)."""
    docs = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return neighbours(spark, d, 10).join(docs, "doc_id").select("qid", "rank", "doc_id", "score", "title")


def q_knn_exact_l2(spark, d):
    return neighbours(spark, d, 10, "l2")


def q_knn_cosine(spark, d):
    return neighbours(spark, d, 5, "cosine")


def q_threshold_curve(spark, d):
    """Share of vectors whose nearest other vector is at least that similar."""
    best = neighbours(spark, d, 1, "cosine").select("score")
    steps = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    one = best.agg(*(F.avg((F.col("score") >= t).cast("int")).alias(f"t{k}") for k, t in enumerate(steps)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.round(f"t{k}", 6).alias("share")) for k, t in enumerate(steps)))).alias("x")).select("x.*")


def centroids(e: DataFrame) -> DataFrame:
    """(label, c): mean of each coordinate by label; partial aggregates, no vector gathered."""
    x = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("c"))


def probes(e: DataFrame, nprobe: int) -> DataFrame:
    """(qid, label): the lists whose centroids are nearest to each vector. The centroid table is small by construction."""
    s = e.select(F.col("id").alias("qid"), F.col("v").alias("q")).join(F.broadcast(centroids(e)), F.lit(True))
    s = s.select("qid", "label", F.round(dot(F.col("q"), F.col("c")), 9).alias("s"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "label"))
    return s.withColumn("r", r).where(F.col("r") <= nprobe).select("qid", "label", F.col("r").alias("probe"))


def list_search(e: DataFrame, probe: DataFrame, k: int) -> DataFrame:
    """Top k by inner product among the vectors of the probed lists.

    A list is cut into pieces of about CELL_CORPUS vectors, its queries into shares of at most about CELL_QUERIES; a cell
    holds a share with each query's k best and streams a piece past it. A cell's memory is bounded, whatever the
    list's size and however many queries probe it, and it gives k rows a query.
    """
    usable = e.where("v is not null and size(v) > 0 and id is not null")
    sizes = usable.groupBy("label").agg(F.count("*").alias("n"))
    lists, n = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    spread = -(-2 * e.sparkSession.sparkContext.defaultParallelism // max(1, lists))
    shares = max(1, -(-n // CELL_QUERIES), min(-(-n // BLOCK), spread))
    pieces = sizes.select("label", F.ceil(F.col("n") / CELL_CORPUS).alias("pieces"))
    each = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), x - 1))
    asks = probe.select("qid", "label").join(usable.select(F.col("id").alias("qid"), "v"), "qid").join(pieces, "label")
    asks = asks.select("label", F.pmod(F.xxhash64("qid"), F.lit(shares)).alias("share"), each(F.col("pieces")).alias("piece"), F.lit(0).alias("side"), F.col("qid").alias("id"), "v")
    own = usable.join(pieces, "label").select("label", each(F.lit(shares)).alias("share"), F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece"), F.lit(1).alias("side"), "id", "v")
    cells = asks.union(own).withColumn("cell", F.xxhash64("label", "share", "piece"))
    dealt = cells.select("cell", "side", "id", "v").repartition(max(1, lists) * shares, "cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for h in held:
                r, j = np.nonzero(np.isfinite(h.best))
                yield pa.RecordBatch.from_pydict({"qid": h.ids[r], "doc_id": h.found[r, j], "s": h.best[r, j]})

        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows, -1)
            at, side, ids = (b.column(c).to_numpy() for c in ("cell", "side", "id"))
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if at[start] != cell:
                    yield from done()
                    cell, held = at[start], []
                for lo in range(start, end, BLOCK):
                    part = slice(lo, min(lo + BLOCK, end))
                    if side[start] == 0:
                        held.append(Best(ids[part], flat[part], k, "ip"))
                        continue
                    for h in held:
                        h.see(ids[part], flat[part], True)
        yield from done()

    hits = dealt.mapInArrow(run, "qid long, doc_id long, s double")
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "doc_id"))
    return hits.withColumn("rank", r).where(F.col("rank") <= k).select("qid", "rank", "doc_id", F.round("s", 6).alias("score"))


def q_ivf_label_probe(spark, d):
    e = embeddings(spark, d)
    return list_search(e, probes(e, 2), 5)


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    hit = truth.select("qid", "doc_id").join(found.select("qid", "doc_id").withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / k).alias("r")).agg(F.round(F.avg("r"), 6).alias("recall"))


def q_ivf_recall_vs_nprobe(spark, d):
    e = embeddings(spark, d)
    with Scratch(spark) as scratch:
        truth, lists = scratch.stored(neighbours(spark, d, 5), "truth"), scratch.stored(probes(e, 10), "probes")
        parts = [recall(truth, list_search(e, lists.where(F.col("probe") <= n), 5), 5).select(F.lit(n).alias("nprobe"), "recall") for n in (1, 3, 10)]
        return scratch.kept(parts[0].union(parts[1]).union(parts[2]))


def q_ivf_warmstart(spark, d):
    """Each vector's nearest other vector chooses the lists; recall of the search by those against exact truth."""
    e = embeddings(spark, d)
    with Scratch(spark) as scratch:
        truth, cold = scratch.stored(neighbours(spark, d, 5), "truth"), scratch.stored(probes(e, 2), "probes")
        near = truth.where("rank = 1").select("qid", F.col("doc_id").alias("other"))
        warm = near.join(cold.withColumnRenamed("qid", "other"), "other").select("qid", "label")
        parts = [recall(truth, list_search(e, x, 5), 5).select(F.lit(start).alias("start"), "recall") for start, x in (("cold", cold), ("warm", warm))]
        return scratch.kept(parts[0].union(parts[1]))


def scalar_quantized(e: DataFrame) -> DataFrame:
    """(id, code): per coordinate 8 bits between its least and greatest value; and what the codes stand for."""
    x = e.select("id", F.posexplode("v").alias("i", "x"))
    span = x.groupBy("i").agg(F.min("x").cast("double").alias("lo"), F.max("x").cast("double").alias("hi"))
    one = span.agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("span"))
    y = e.join(F.broadcast(one), F.lit(True))
    code = F.zip_with("v", "span", lambda x, s: F.when(s.hi > s.lo, F.floor((x.cast("double") - s.lo) / (s.hi - s.lo) * 255 + 0.5)).otherwise(F.lit(0)).cast("int"))
    y = y.select("id", "label", "span", code.alias("code"))
    return y.select("id", "label", "code", F.zip_with("code", "span", lambda c, s: s.lo + c * (s.hi - s.lo) / 255).alias("v"))


def q_sq8_knn(spark, d):
    e = embeddings(spark, d)
    return top_k(e, scalar_quantized(e).select("id", "v"), 5, "ip", same=True)


def q_index_describe(spark, d):
    e = embeddings(spark, d)
    return e.agg(F.count("*").alias("ntotal"), F.max(F.size("v")).alias("dim"), F.sum(F.size("v").cast("long") * 4).alias("bytes"), F.count_if(F.size("v") != 64).alias("wrong_dim"), F.round(F.max(F.abs(norm(F.col("v")) - 1)), 3).alias("norm_off"))


def q_index_parameters(spark, d):
    """Lists, training rows, probes and graph search width by rule, over a ladder of sizes."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"), "n").select("step", (F.col("n") * F.pow(F.lit(10.0), F.col("step"))).cast("long").alias("n"))
    raw = F.least(F.greatest(F.sqrt("n") * 4, F.lit(1024.0)), F.lit(65536.0))
    n = n.withColumn("nlist", F.pow(F.lit(2.0), F.rint(F.log2(raw))).cast("long"))
    return n.select(
        "step", "n", "nlist",
        F.least("n", F.least(F.greatest(F.col("nlist") * 100, F.lit(100_000)), F.lit(2_000_000))).alias("train"),
        F.least(F.greatest(F.rint(F.col("nlist") * 0.005).cast("long"), F.lit(16)), F.lit(256)).alias("nprobe"),
        F.when(F.col("n") <= 100_000, 64).when(F.col("n") <= 1_000_000, 128).when(F.col("n") <= 10_000_000, 256).otherwise(512).alias("ef_search"),
        F.format_string("ivf_n%d_l%d", "n", "nlist").alias("name"),
    )


def q_tiered_latency(spark, d):
    rates = spark.createDataFrame([(0.3,), (0.5,), (0.7,), (0.9,)], "hit_rate double")
    t = embeddings(spark, d).agg((F.count("*") * 0.001).alias("t_full"), (F.count_if(F.col("id") % 10 == 0) * 0.001).alias("t_hot"))
    return t.join(F.broadcast(rates), F.lit(True)).select("hit_rate", F.round(F.col("t_hot") + (1 - F.col("hit_rate")) * F.col("t_full"), 6).alias("expected_ms"))


def q_mean_pooling(spark, d):
    """Mean of each coordinate over vectors of a label, positives only (the mask)."""
    x = embeddings(spark, d).select("label", F.posexplode("v").alias("i", "x")).where("x > 0")
    return x.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


QUERIES = {
    "knn_exact_ip": q_knn_exact_ip, "knn_exact_l2": q_knn_exact_l2, "knn_cosine": q_knn_cosine, "threshold_curve": q_threshold_curve, "ivf_label_probe": q_ivf_label_probe, "ivf_recall_vs_nprobe": q_ivf_recall_vs_nprobe, "ivf_warmstart": q_ivf_warmstart,
    "sq8_knn": q_sq8_knn, "index_describe": q_index_describe, "index_parameters": q_index_parameters, "tiered_latency": q_tiered_latency, "mean_pooling": q_mean_pooling,
}

#: Exact neighbours in DuckDB, as a chain of common table expressions.
SCORED = "with e as (select vec_id as id, embedding::double[] as v, label from embeddings), s as (select a.id as qid, b.id as doc_id, round({score}, 9) as s from e a join e b on a.id <> b.id), r as (select *, row_number() over (partition by qid order by s desc, doc_id)::int as rank from s)"
IP = SCORED.format(score="list_inner_product(a.v, b.v)")
COSINE = SCORED.format(score="list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-12) * (sqrt(list_inner_product(b.v, b.v)) + 1e-12))")
L2 = SCORED.format(score="-(list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v))")
LISTS = IP + """, x as (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e), m as (select label, i, round(avg(x), 9) as m from x group by all),
c as (select label, list(m order by i) as c from m group by label),
p as (select qid, label, row_number() over (partition by qid order by s desc, label) as probe from (select e.id as qid, c.label, round(list_inner_product(e.v, c.c), 9) as s from e cross join c)),
t as (select qid, doc_id from r where rank <= 5)"""
_PROBED = "select p.qid, b.id as doc_id, round(list_inner_product(a.v, b.v), 9) as s from {p} p join e a on a.id = p.qid join e b on b.label = p.label and b.id <> p.qid where {where}"
_RANKED = "(select *, row_number() over (partition by qid order by s desc, doc_id)::int as rank from ({x}))"
_RECALL = "(select round(avg(r), 6) as recall from (select t.qid, count(f.doc_id) / 5.0::double as r from t left join (select qid, doc_id from {x} where rank <= 5) f using (qid, doc_id) group by t.qid))"


def _recall(n: int) -> str:
    return _RECALL.format(x=_RANKED.format(x=_PROBED.format(p="p", where=f"p.probe <= {n}")))


ORACLE_SQL = {
    "knn_exact_ip": IP + " select qid, rank, doc_id, round(s, 6) as score, split_part(text, chr(10), 1) as title from r join documents using (doc_id) where rank <= 10",
    "knn_exact_l2": L2 + " select qid, rank, doc_id, round(-s, 6) as score from r where rank <= 10",
    "knn_cosine": COSINE + " select qid, rank, doc_id, round(s, 6) as score from r where rank <= 5",
    "threshold_curve": COSINE + ", b as (select round(s, 6) as s from r where rank = 1) select t::double as threshold, round(avg((s >= t)::int), 6) as share from b cross join (select unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::double[]) as t) group by t",
    "ivf_label_probe": LISTS + " select qid, rank, doc_id, round(s, 6) as score from " + _RANKED.format(x=_PROBED.format(p="p", where="p.probe <= 2")) + " where rank <= 5",
    "ivf_recall_vs_nprobe": LISTS + f" select 1 as nprobe, recall from {_recall(1)} union all select 3, recall from {_recall(3)} union all select 10, recall from {_recall(10)}",
    "ivf_warmstart": LISTS + ", w as (select r.qid, p.label from r join p on p.qid = r.doc_id where r.rank = 1 and p.probe <= 2)" + f" select 'cold' as start, recall from {_recall(2)} union all select 'warm', recall from " + _RECALL.format(x=_RANKED.format(x=_PROBED.format(p="w", where="true"))),
    "sq8_knn": """with e as (select vec_id as id, embedding::double[] as v from embeddings), x as (select id, unnest(v) as x, generate_subscripts(v, 1) as i from e),
sp as (select i, min(x) as lo, max(x) as hi from x group by i),
y as (select id, i, lo + case when hi > lo then floor((x - lo) / (hi - lo) * 255 + 0.5) else 0 end * (hi - lo) / 255 as y from x join sp using (i)),
f as (select id, list(y order by i) as v from y group by id),
s as (select a.id as qid, b.id as doc_id, round(list_inner_product(a.v, b.v), 9) as s from e a join f b on a.id <> b.id),
r as (select *, row_number() over (partition by qid order by s desc, doc_id)::int as rank from s) select qid, rank, doc_id, round(s, 6) as score from r where rank <= 5""",
    "index_describe": "select count(*) as ntotal, max(len(embedding))::int as dim, sum(len(embedding) * 4)::bigint as bytes, count(*) filter (len(embedding) <> 64) as wrong_dim, round(max(abs(sqrt(list_inner_product(embedding::double[], embedding::double[])) - 1)), 3) as norm_off from embeddings",
    "index_parameters": """with n as (select step::int as step, (c * pow(10.0::double, step))::bigint as n from (select count(*) as c from documents) cross join (select unnest(range(8)) as step)),
l as (select *, pow(2.0::double, round_even(log2(least(greatest(sqrt(n) * 4, 1024.0), 65536.0)), 0))::bigint as nlist from n)
select step, n, nlist, least(n, least(greatest(nlist * 100, 100000), 2000000)) as train, least(greatest(round_even(nlist * 0.005::double, 0)::bigint, 16), 256) as nprobe,
  case when n <= 100000 then 64 when n <= 1000000 then 128 when n <= 10000000 then 256 else 512 end as ef_search, 'ivf_n' || n || '_l' || nlist as name from l""",
    "tiered_latency": "select h::double as hit_rate, round(count(*) filter (vec_id % 10 = 0) * 0.001::double + (1 - h::double) * (count(*) * 0.001::double), 6) as expected_ms from embeddings cross join (select unnest([0.3, 0.5, 0.7, 0.9]) as h) group by h",
    "mean_pooling": "select label, (i - 1)::int as i, round(avg(x::double), 6) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) where x > 0 group by all",
}
