"""BM25 over a stored index of posting blocks: each block has its best impact, and blocks that cannot reach the k best are skipped.

``write_postings`` takes the collection's size from one pass and then builds shard by shard, where the texts are: a
shard's documents are numbered in windows of ``WINDOW``; a term's postings in a window are a block with the best impact
among them, rounded up. One row a shard and term, one with the shard's ids and lengths; nothing is shuffled.

``search_postings`` reads the rows of the queries' terms, and brings them together by shard and block of queries. A
query adds up its terms' best impacts window by window; that bounds every document there. Windows are scored from the
highest bound down, in growing portions, until the next bound is below the k-th score: a result is exact, and most
documents that share a common word with the query are never scored.

Terms are runs of a to z and 0 to 9 of the text in lower case. A text without terms counts as a document, but is never found. Rows that repeat an
id are documents of their own; null ids are passed over. A query's terms count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.operators.lexical import B, K1, terms
from orrery.sources.scratch import Scratch

#: Documents of a window, bytes of text in a shard, windows in the first portion, queries of a block, rows that are broadcast at most.
WINDOW, SHARD_BYTES, PORTION, QUERIES_OF_BLOCK, FEW = 4, 24 << 20, 32, 256, 200_000
#: What rounding to six digits may add to a score, with room.
SLACK = 1e-5
SPACED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))

POSTINGS = "shard string, term string, df long, windows binary, best binary, starts binary, places binary, tfs binary"


def norms(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return K1 * (1 - B + B * lengths * n / total)


class Shard:
    def __init__(self, n: int, total: int) -> None:
        self.n, self.total = n, total
        self.known: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.terms: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, text: bytes | None) -> None:
        words = (text or b"").translate(SPACED).split()
        if words and doc is not None:
            known = self.known
            self.ids.append(doc)
            self.terms.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            self.size += len(text)

    def rows(self, name: str) -> pa.RecordBatch:
        count = len(self.ids)
        lengths = np.array(list(map(len, self.terms)), np.int64)
        pairs, tf = np.unique(np.concatenate(self.terms).astype(np.int64) * count + np.repeat(np.arange(count), lengths), return_counts=True)
        term, doc = pairs // count, pairs % count
        impact = tf * (K1 + 1) / (tf + norms(lengths, self.n, self.total)[doc])
        window = doc // WINDOW
        of_term = np.searchsorted(term, np.arange(len(self.known) + 1))
        blocks = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (window[1:] != window[:-1])))
        best = np.nextafter(np.maximum.reduceat(impact, blocks).astype("<f4"), np.float32(np.inf))
        cuts = np.searchsorted(blocks, of_term)
        starts = (blocks - of_term[:-1].repeat(np.diff(cuts))).astype("<i4")
        parts = lambda x, at: [x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        head = (name, None, count, np.array(self.ids, "<i8").tobytes(), lengths.astype("<i8").tobytes(), None, None, None)
        own = (parts(window[blocks].astype("<i4"), cuts), parts(best, cuts), parts(starts, cuts), parts((doc % WINDOW).astype("u1"), of_term), parts(tf.astype("<i4"), of_term))
        columns = [[name] * len(self.known), [w.decode() for w in self.known], np.diff(of_term).tolist(), *own]
        kinds = (pa.string(), pa.string(), pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array([h, *c], k) for h, c, k in zip(head, columns, kinds, strict=True)], [x.split(" ")[0] for x in POSTINGS.split(", ")])


def write_postings(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """The index of documents (doc_id, text) at ``path``/postings, its statistics (n, total) at ``path``/statistics."""
    spark = docs.sparkSession
    docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(terms(F.coalesce("text", F.lit("")))).cast("long")), F.lit(0)).alias("total")).write.parquet(f"{path}/statistics")
    n, total = spark.read.parquet(f"{path}/statistics").first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        shard = Shard(n, total)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard.add(doc, text.as_py())
                if shard.size >= shard_bytes:
                    yield shard.rows(uuid.uuid4().hex)
                    shard = Shard(n, total)
        if shard.ids:
            yield shard.rows(uuid.uuid4().hex)

    rows = docs.select(F.col("doc_id").cast("long"), F.lower("text").cast("binary"))
    rows.mapInArrow(run, POSTINGS).write.option("compression", "zstd").parquet(f"{path}/postings")


class Searched:
    """One shard's ids, lengths and the postings of the terms that are asked for."""

    def __init__(self, ids: bytes, lengths: bytes, n: int, total: int) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.norm = norms(np.frombuffer(lengths, "<i8"), n, total)
        self.windows = -(-len(self.ids) // WINDOW)
        self.scored = 0

    @staticmethod
    def list_of(row: dict) -> tuple[np.ndarray, ...]:
        return tuple(np.frombuffer(row[c], t) for c, t in (("windows", "<i4"), ("best", "<f4"), ("starts", "<i4"), ("places", "u1"), ("tfs", "<i4")))

    def search(self, lists: list[tuple[float, tuple[np.ndarray, ...]]], k: int) -> list[tuple[float, int]]:
        """The k best (score, id) and all that tie with them when rounded; lists: (idf, postings) of the query's terms."""
        bound = np.zeros(self.windows)
        for idf, (windows, best, *_) in lists:
            bound[windows] += idf * best
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, chosen, bar, at, portion = np.zeros(len(self.ids)), np.zeros(self.windows, bool), -np.inf, 0, PORTION
        found: list[np.ndarray] = []
        while at < len(order) and bound[order[at]] + SLACK >= bar:
            now = order[at : at + portion]
            now = now[bound[now] + SLACK >= bar]
            chosen[now] = True
            docs = []
            for idf, (windows, _, starts, places, tfs) in lists:
                blocks = np.flatnonzero(chosen[windows])
                if not len(blocks):
                    continue
                size = np.diff(np.append(starts, len(places)))[blocks]
                posting = np.repeat(starts[blocks], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                doc = np.repeat(windows[blocks], size) * WINDOW + places[posting]
                tf = tfs[posting]
                score[doc] += idf * tf * (K1 + 1) / (tf + self.norm[doc])
                docs.append(doc)
            chosen[now] = False
            found.append(np.unique(np.concatenate(docs)))
            self.scored += len(found[-1])
            every = score[np.concatenate(found)]
            if len(every) >= k:
                bar = np.partition(every, len(every) - k)[len(every) - k]
            at, portion = at + portion, 2 * portion
        docs = np.concatenate(found) if found else np.zeros(0, np.int64)
        docs = docs[score[docs] + SLACK >= bar]
        return list(zip(score[docs].tolist(), self.ids[docs].tolist(), strict=True))


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score) of queries (qid, text)."""
    index = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    n, total = spark.read.parquet(f"{path}/statistics").first()
    blocks = max(1, -(-queries.count() // QUERIES_OF_BLOCK))
    asked = queries.select("qid", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    df = index.where("term is not null").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").groupBy("block", "term").agg(F.first(idf).alias("idf"), F.collect_list("qid").alias("qids"))  # a block has QUERIES_OF_BLOCK queries on average
    if weighed.count() <= FEW:
        weighed = F.broadcast(weighed)
    columns = ("windows", "best", "starts", "places", "tfs")
    cells = index.where("term is not null").join(weighed, "term").select("shard", "block", F.lit(1).alias("kind"), "idf", "qids", *columns)
    head = index.where("term is null").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(0).alias("kind"), F.lit(0.0).alias("idf"), F.lit(None).cast("array<bigint>").alias("qids"), *columns)
    dealt = head.union(cells).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, shard, lists = None, None, {}

        def done() -> Iterator[pa.RecordBatch]:
            found = [(q, i, s) for q, own in lists.items() for s, i in shard.search(own, k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["qid", "doc_id", "s"])

        for b in batches:
            for r in b.to_pylist():
                if (r["shard"], r["block"]) != cell:
                    yield from done()
                    cell, lists = (r["shard"], r["block"]), {}
                if r["kind"] == 0:
                    shard = Searched(r["windows"], r["best"], n, total)
                else:
                    postings = shard.list_of(r)
                    for q in r["qids"]:
                        lists.setdefault(q, []).append((r["idf"], postings))
        yield from done()

    hits = dealt.mapInArrow(run, "qid long, doc_id long, s double").select("qid", "doc_id", F.round("s", 6).alias("score"))
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", r).where(F.col("rank") <= k).select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


def bm25_stored(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Okapi BM25 of queries (qid, text) over docs (doc_id, text), through an index that is written and read again."""
    with Scratch(docs.sparkSession) as s:
        path = s.path("postings")
        write_postings(docs, path)
        return s.kept(search_postings(docs.sparkSession, path, queries, k))
