"""Line dedup: levelled sorted runs of line hashes, compacted periodically; each batch merge-anti-joins the runs and adds its own.

A line's key is the line without white space (the six kinds) at its ends, A to Z in lower case; keys of at least
``MIN_CHARS`` code points are hashed to 128 bits. A key that ``MIN_DOCS`` documents hold loses all its lines but
those of the document with the largest id that holds it.

Documents come in batches (by id, largest first, when a table is at hand as a whole). A batch is reduced to one row
a key: how many of its documents hold the key, and the largest. Rows that a run has settled already (documents enough,
and one at least as large) are anti-joined away; the rest is written as a run of level 0. Runs are bucketed by key
and sorted in their buckets, so the join is a merge of sorted files and shuffles only the batch. A level that has
``fanout`` runs is merged into one run of the next. So a line that stands in a third of all documents is written a
few times, not once a batch, and every row is rewritten at most once a level.

Which batch a document is in changes the work, never the result: the sum over all runs of a key's documents is either
its count or, where rows were settled, at least MIN_DOCS; the largest document is always in some run.

Null or empty text: one empty line, nothing dropped; a null stays null. Very long texts are read whole. Rows that
repeat an id are one document; rows without id are together one document, smaller than any other. Copies are all
counted. Other columns pass through untouched, whatever their names. Empty table: empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.llm import common

#: Fixed values of the contract: code points of a key, documents that make it boilerplate.
MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of a whole table, runs of a level before they are merged.
BATCHES, FANOUT = 6, 3
CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is shorter than ``least`` code points."""
    key = line.strip().lower()  # of bytes: the six ASCII spaces, A to Z
    if len(key) < least or (not key.isascii() and len(key.translate(None, CONTINUATION)) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def hashed(docs: DataFrame, key: str, text: str, least: int = MIN_CHARS) -> DataFrame:
    """(doc, line): each line hash of each row once. Run it in ``common.small_batches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, lines = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {line_key(x, least) for x in (t or b"").split(b"\n")} - {None}
                docs += [d] * len(own)
                lines += own
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lines, pa.binary())], ["doc", "line"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(run, "doc long, line binary")


def least_id(c: str | Column) -> Column:
    """Orders ids with null before all others."""
    return F.struct(F.col(c).isNotNull(), F.col(c)) if isinstance(c, str) else F.struct(c.isNotNull(), c)


class Runs:
    """The levels of sorted runs: rows (line, docs, last), ``last`` the largest id among the documents of that run that hold the line."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def written(self, rows: DataFrame) -> str:
        """One sorted run: a table bucketed by line, in the shared folder."""
        name, path = f"orrery_run_{uuid.uuid4().hex}", common.new_path(self.spark, "run")
        rows = rows.repartition(self.buckets, "line")
        rows.write.bucketBy(self.buckets, "line").sortBy("line").option("compression", "zstd").option("path", path).saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows (line, docs, last) of ``batch`` that no run has settled."""
        for run in self.tables():
            done = run.where(F.col("docs") >= self.min_docs).select(F.col("line").alias("_line"), F.col("last").alias("_last"))
            batch = batch.join(done.hint("merge"), (F.col("line") == F.col("_line")) & (least_id("_last") >= least_id("last")), "left_anti")
        return batch

    def add(self, lines: DataFrame) -> None:
        """Adds a batch (doc, line) of documents that no earlier batch had; merges full levels."""
        each = lines.groupBy("line").agg((F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("long"))).alias("docs"), F.max("doc").alias("last"))
        self.levels[0].append(self.written(self.fresh(each)))
        for k in range(99):
            if len(self.levels[k]) < self.fanout:
                break
            merged = self.written(self.merged([self.spark.table(n) for n in self.levels[k]]))
            self.forget(k)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)

    def merged(self, tables: list[DataFrame]) -> DataFrame:
        """One row a line: a merge of the sorted runs, two at a time (a union would lose their buckets)."""
        rows = tables[0]
        for t in tables[1:]:
            t = t.withColumnsRenamed({"docs": "_docs", "last": "_last"})
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
            rows = rows.join(t.hint("merge"), "line", "full_outer").select("line", docs.alias("docs"), F.greatest("last", "_last").alias("last"))
        return rows

    def repeated(self) -> DataFrame:
        """(line, last) of every line that enough documents hold."""
        tables = self.tables()
        if not tables:
            return self.spark.createDataFrame([], "line binary, last long")
        return self.merged(tables).where(F.col("docs") >= self.min_docs).select("line", "last")

    def forget(self, level: int) -> None:
        for name in self.levels[level]:
            common.dropped(self.spark.table(name))
            self.spark.sql(f"drop table {name}")
        self.levels[level] = []

    def close(self) -> None:
        for k in range(len(self.levels)):
            self.forget(k)


def in_batches(lines: DataFrame, batches: int) -> tuple[DataFrame, list[int]]:
    """(doc, line, batch) written by batch, and the batches there are: ranges of ids of about as many rows, the largest ids in batch 0."""
    cuts = lines.agg(F.percentile_approx("doc", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    at = F.lit(batches - 1)
    for k, cut in enumerate(sorted(set(cuts))):
        at = F.when(F.col("doc") > cut, batches - 2 - k).otherwise(at)
    path = common.new_path(lines.sparkSession, "lines")
    lines.withColumn("batch", at).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    back = lines.sparkSession.read.schema("doc long, line binary, batch int").parquet(path)
    return back, sorted(r[0] for r in back.select("batch").distinct().collect())


def losses(lines: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, gone): for each document the hashes of the lines that it loses; lines: (doc, line)."""
    spark = lines.sparkSession
    dealt, there = in_batches(lines, batches)
    runs = Runs(spark, min_docs, fanout)
    try:
        for b in there:
            runs.add(dealt.where(F.col("batch") == b).select("doc", "line"))
        boiler = common.stored(runs.repeated(), "boiler")
    finally:
        runs.close()
    lost = dealt.join(common.small(boiler), "line").where(~F.col("doc").eqNullSafe(F.col("last")))
    lost = common.stored(lost.groupBy("doc").agg(F.collect_set("line").alias("gone")), "gone")
    if there:
        common.dropped(dealt)
    return lost


def without_lines(docs: DataFrame, lost: DataFrame, key: str, text: str, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines of ``lost``, and two columns more, n_lines and n_dropped (with underscores, if taken). Run it in ``common.small_batches``."""
    n_lines, n_dropped, gone, doc = (common.free_name(docs, n) for n in ("n_lines", "n_dropped", "_gone", "_doc"))
    lost = lost.withColumnsRenamed({"doc": doc, "gone": gone})
    # sorted and merged at any size, so that what is shuffled grows with the texts alone
    rows = docs.join(lost.hint("merge"), F.col(key).cast("long").eqNullSafe(F.col(doc)), "left").select(*docs.columns, gone)
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(n_lines, LongType()), StructField(n_dropped, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found, dropped = b.column(place).cast(pa.binary()).to_pylist(), [], []
            for i, sets in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if not sets:
                    found.append((texts[i] or b"").count(b"\n") + 1)
                    dropped.append(0)
                    continue
                sets, lines = set(sets), (texts[i] or b"").split(b"\n")
                kept = [x for x in lines if line_key(x, least) not in sets]
                texts[i] = b"\n".join(kept)
                found.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = list(b.columns[:-1])
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            columns += [pa.array(x, pa.int64()) for x in (found, dropped)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` without repeated lines, with n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    with common.temporary() as keep, common.small_batches(spark):
        lines = common.stored(hashed(docs, key, text, min_chars), "hashed")
        return keep(common.stored(without_lines(docs, losses(lines, min_docs, batches, fanout), key, text, min_chars), "lines"))


def op11_line_runs(spark, sf_dir: str) -> DataFrame:
    rows = deduped(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op11_line_runs": op11_line_runs}
ORACLE_SQL = {
    "op11_line_runs": """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select k.doc_id, k.n, k.line, r.last is not null and k.doc_id <> r.last as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from j group by doc_id"""
}
