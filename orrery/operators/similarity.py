"""Exact cosine join with a threshold: every pair, no cap on neighbours.

Vectors are normalised, ordered by the pivot nearest to them (a bounded sample) and packed into blocks of ``BLOCK``; a
block knows its centre and the greatest angle from it. Groups of blocks meet in the cells of a triangular grid; a block goes to
each cell of its group, a pair is a row only when it is a result. In a cell two blocks are passed over when their
centres are farther apart than both radii and the threshold's angle allow. Else the products of the first ``PREFIX``
coordinates, plus those of the rests' lengths, bound every pair (Cauchy-Schwarz); rows that no bound lifts
to the threshold are left out of the whole product. Where the rests alone reach the threshold no prefix is tried. Bounds
have room for rounding, so the join is exact. What is wanted of the pairs is made in the cell, so they need not be rows.

Null or empty vectors, or without id, are in no pair; a zero vector is like nothing. Ids are expected once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.inverted import matrix, sampled
from orrery.operators.vectors import COSINE, ERROR, embeddings
from orrery.sources.scratch import Scratch

#: Vectors of a block, vectors of a group (a cell holds two), pivots at most, coordinates of a prefix, rows of a result's batch.
BLOCK, GROUP, PIVOTS, PREFIX, BATCH = 256, 32_768, 256, 16, 16_384
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.sqrt((x * x).sum(1)) + 1e-12)[:, None]


class Block:
    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.short = ids, x, x.astype(np.float32)
        centre = x.sum(0)
        length = np.sqrt(centre @ centre)
        self.centre = centre / length if length > 1e-9 else None
        self.radius = float(np.arccos(np.clip(x @ self.centre, -1, 1)).max()) if self.centre is not None else np.pi
        self.rest = np.sqrt((x[:, PREFIX:] ** 2).sum(1))
        self.middle = float(np.median(self.rest))
        self.more: np.ndarray | None = None

    def pairs(self, other: Block, least: float, exact: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(place here, place there, cosine) of all pairs of ``least`` and more, within the slack; None: passed over by the angle.

        If not ``exact``, a cosine may be of four bytes a number where these are sure to be ``least`` and more.
        """
        if self.centre is not None and other.centre is not None:
            between = float(np.arccos(np.clip(self.centre @ other.centre, -1, 1)))
            if between - self.radius - other.radius > np.arccos(least) + SLACK:
                return None
        if self.middle * other.middle >= least and not exact:
            room = SLACK + ERROR * (self.x.shape[1] + 4)
            hit = np.flatnonzero((s := self.short @ other.short.T) >= least - room)
            (i, j), sim = np.divmod(hit, len(other.x)), s.ravel()[hit].astype(float)
            near = np.flatnonzero(sim < least + room)
            sim[near] = np.einsum("ij,ij->i", self.x[i[near]], other.x[j[near]])
            return i, j, sim
        if self.middle * other.middle >= least:
            hit = np.flatnonzero((s := self.x @ other.x.T) >= least - SLACK)
            return *np.divmod(hit, len(other.x)), s.ravel()[hit]
        most = self.x[:, :PREFIX] @ other.x[:, :PREFIX].T + self.rest[:, None] * other.rest[None, :] >= least - SLACK
        a, b = np.flatnonzero(most.any(1)), np.flatnonzero(most.any(0))
        s = self.x[a] @ other.x[b].T
        i, j = np.nonzero(s >= least - SLACK)
        return a[i], b[j], s[i, j]


def packed(vectors: DataFrame, groups: int) -> DataFrame:
    """(grp, dim, ids, data, more): blocks in groups of like vectors, with the numbers ``more`` of each; four bytes a coordinate where no more is needed. Store it: a group is the place of a task."""
    pivots = sampled(vectors, PIVOTS).select("v").collect()
    centres = unit(np.array([r[0] for r in pivots], float)) if pivots else np.zeros((0, 0))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((matrix(b.column(1)) @ centres.T).argmax(1))], ["id", "v", "more", "pivot"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = matrix(part.column(1))
                short = x.astype("<f4")
                more = part.column(2).flatten().to_numpy().astype("<i8").tobytes()
                yield pa.RecordBatch.from_pydict({"grp": pa.array([place], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), "ids": [part.column(0).to_numpy().astype("<i8").tobytes()], "data": [(short if (short == x).all() else x.astype("<f8")).tobytes()], "more": [more]})

    dealt = vectors.mapInArrow(nearest, "id long, v array<double>, more array<long>, pivot long").repartitionByRange(groups, "pivot", "id").sortWithinPartitions("pivot", "id")
    return dealt.select("id", "v", "more").mapInArrow(blocks, "grp int, dim int, ids binary, data binary, more binary")


class Pairs:
    """What a cell makes of its pairs: a row each."""

    schema = "i long, j long, sim double"
    #: Whether similarities are wanted, not only which pairs there are.
    exact = True

    def add(self, i: np.ndarray, j: np.ndarray, sim: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[dict]:
        """Pairs i < j, with the numbers ``more`` of each side."""
        yield {"i": i, "j": j, "sim": sim}

    def end(self) -> Iterator[dict]:
        """After a cell's last pair."""
        return iter(())


class Gathered:
    """Rows gathered into batches of ``BATCH`` and more: two blocks may give few, and a batch has its price."""

    def __init__(self) -> None:
        self.held: list[pa.RecordBatch] = []

    def batches(self, parts: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            self.held.append(pa.RecordBatch.from_pydict(part))
            if sum(b.num_rows for b in self.held) >= BATCH:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.concat_batches(self.held)
            self.held = []


def millionths(sim: np.ndarray) -> np.ndarray:
    """Rounded to nine digits, then half up to six, as whole numbers."""
    return (np.rint(sim * 1e9).astype(np.int64) + 500) // 1000


def cosine_join(vectors: DataFrame, least: float, made: type[Pairs] = Pairs, name: str = "pairs") -> DataFrame:
    """(i, j, sim) of every pair i < j of vectors (id, v) whose cosine, rounded to six digits, is ``least`` or more; or what ``made`` makes of
    those pairs. It may read numbers of both sides: a column ``more`` (array of whole numbers, one length) of the vectors."""
    if not 0 < least <= 1:
        raise ValueError(f"a threshold is above 0 and at most 1, not {least}")
    more = F.col("more").cast("array<long>") if "more" in vectors.columns else F.array().cast("array<long>")
    vectors = vectors.select("id", F.col("v").cast("array<double>").alias("v"), more.alias("more")).where("v is not null and size(v) > 0 and id is not null")
    with Scratch(vectors.sparkSession) as s:
        count = vectors.count()
        groups = max(1, -(-count // GROUP), min(vectors.sparkSession.sparkContext.defaultParallelism, count // BLOCK))
        blocks = s.stored(packed(vectors, groups), "blocks")
        other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
        x, y = F.least("grp", "other"), F.greatest("grp", "other")
        dealt = blocks.select("*", other).withColumns({"x": x, "y": y}).drop("other").withColumn("cell", F.expr(f"x * {groups} - x * (x - 1) div 2 + y - x").cast("int"))
        dealt = dealt.repartitionById(groups * (groups + 1) // 2, F.col("cell")).sortWithinPartitions("cell", "grp")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, held, out, full = None, [], made(), Gathered()
            for b in batches:
                for at in range(b.num_rows):
                    r = {c: b.column(c)[at].as_py() for c in b.schema.names}
                    if r["cell"] != cell:
                        yield from full.batches(out.end())
                        cell, held, out = r["cell"], [], made()
                    ids = np.frombuffer(r["ids"], "<i8")
                    x = np.frombuffer(r["data"], f"<f{len(r['data']) // (len(ids) * r['dim'])}").astype("<f8")
                    block = Block(ids, unit(x.reshape(-1, r["dim"])))
                    block.more = np.frombuffer(r["more"], "<i8").reshape(len(block.ids), -1)
                    one = r["x"] == r["y"]  # a group with itself
                    if r["grp"] == r["x"]:
                        held.append(block)
                        if not one:
                            continue
                    for h in held:
                        if (found := h.pairs(block, least, made.exact)) is None:
                            continue
                        p, q, sim = found
                        i, j = h.ids[p], block.ids[q]
                        good = np.flatnonzero((i < j if h is block else i != j) & (millionths(sim) >= round(least * 1e6)))
                        if len(good):
                            p, q, i, j, sim = p[good], q[good], i[good], j[good], sim[good]
                            yield from full.batches(out.add(np.minimum(i, j), np.maximum(i, j), sim, h.more[p], block.more[q]))
            yield from full.batches(out.end())
            yield from full.rest()

        found = dealt.mapInArrow(run, made.schema)
        if "sim" in found.columns:
            found = found.withColumn("sim", F.round(F.round("sim", 9), 6)).where(F.col("sim") >= least)
        return s.kept(found, name)


def similar_pairs(spark, d: str, least: float) -> DataFrame:
    return cosine_join(embeddings(spark, d), least)


def q_knn_cosine_threshold_pairs(spark, d):
    return similar_pairs(spark, d, 0.3)


#: Pairs in DuckDB, as one more common table expression after COSINE.
PAIRS = COSINE + ", pr as (select qid as i, doc_id as j, round(s, 6) as sim from r where qid < doc_id and round(s, 6) >= 0.3)"

QUERIES = {"knn_cosine_threshold_pairs": q_knn_cosine_threshold_pairs}
ORACLE_SQL = {"knn_cosine_threshold_pairs": PAIRS + " select i, j, sim from pr"}
