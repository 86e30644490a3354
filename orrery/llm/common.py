"""What the training-data operators share: shared-folder tables, batches, words, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word of the contracts, in every engine that is used here.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of two longs that are broadcast at most (about 10 MB as a hash table).
SMALL_ROWS = 200_000

#: Edges in a file of a component step, on average.
PART_EDGES = 100_000

#: Rows handed to Python at a time where rows hold whole texts; bytes of text that are worked on at a time, or one text.
TEXT_ROWS, TEXT_BYTES = 500, 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else, in one process (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"


#: Tables stored inside each open ``temporary`` block, innermost last.
_OPEN: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps survive a lost executor and recompute nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].append(back)
    return back


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/orrery-" in folder:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that have ended: it does when the driver's garbage goes, which may take long on a quiet driver."""
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()  # Spark holds on to its last job
    spark._jvm.System.gc()


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored in this block are deleted at its end, but for those passed to what it yields; an outer block owns them then."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _OPEN.append([])
    try:
        yield keep
    finally:
        made = _OPEN.pop()
        for df in made:
            if not any(df is k for k in kept):
                dropped(df)
        if _OPEN:
            _OPEN[-1].extend(kept)
        if made:
            released(made[0].sparkSession)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table of a few longs a row, marked for broadcast if its counted rows are at most ``rows``; else as it is, to be joined by sorting."""
    return F.broadcast(df) if df.count() <= rows else df


def text_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch of whole texts by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Inside this block an Arrow batch holds about ``size`` of rows at most; the caller's settings are back after it. What runs inside must be eager."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, (str(TEXT_ROWS), size), strict=True):
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each batch as Python lists."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to about TEXT_BYTES of the text column of that place."""
    for b in batches:
        if b.num_rows:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
            starts = group_starts(sizes // TEXT_BYTES)
            for a, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield b.slice(a, e - a)


def keyed_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Splits a stream that is sorted by ``keys`` into tables that hold whole groups only.

    A table holds every row of each of its groups, so at most one batch and one group are in memory.
    """
    rest: list[pa.RecordBatch] = []
    held: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if rest and held != tuple(c[0] for c in columns):
            yield pa.Table.from_batches(rest)
            rest = []
        held = tuple(c[-1] for c in columns)
        other = np.flatnonzero(np.any([c != h for c, h in zip(columns, held, strict=True)], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns that are sorted together; the length comes last."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


class Forest:
    """Union-find over positions 0..n-1 with vectorised look-ups, for one bucket at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def flatten(self) -> np.ndarray:
        while True:
            nxt = self.root[self.root]
            if np.array_equal(nxt, self.root):
                return self.root
            self.root = nxt

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(i), self.find(j)
            if x != y:
                self.root[max(x, y)] = min(x, y)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root), root the smallest node reachable, for every node that has an edge.

    Large-star and small-star steps in turn, each a partial aggregate and a join whose two sides are
    plain exchanges, so that AQE can split a hub. What a step gives is written to the shared folder.
    Nulls and self-loops are dropped. No edges: no rows.
    """

    def star(e: DataFrame, large: bool, parts: int) -> DataFrame:
        if large:
            at = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            at = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = stored(at.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "least")
        with_least = at.join(least, "u")
        if large:
            out = with_least.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = with_least.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        done = stored(out.where("a <> b").distinct().coalesce(parts), "star")
        dropped(least)
        return done

    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    e = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    seen = mark(e)
    parts = -(-seen[0] // PART_EDGES) or 1  # a step never has more edges than the one before
    while seen[0]:
        large = star(e, True, parts)
        dropped(e)
        e = star(large, False, parts)
        dropped(large)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
