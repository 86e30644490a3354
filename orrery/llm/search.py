"""Ranked lexical search: document-at-a-time heap merge over doc_id-sorted compressed postings of each shard, then a global merge.

A shard is what one task has read of the documents, up to ``SHARD_BYTES`` of text. Its documents are numbered by
doc_id; a term's posting list holds their numbers and counts, ascending, as variable-byte gaps. The index is one
Parquet row a shard and term, and one row a shard with its documents' ids and lengths; nothing is shuffled to build it.

Document frequencies and lengths are summed over all shards, so every shard scores as one whole table would.
Queries go in blocks to the shards. In a cell (shard, block) each query merges its posting lists by a heap of cursors,
document by document; the best k stand in a bounded heap keyed by score, then doc_id. Lists whose highest scores
together cannot lift a document over the k-th best leave the heap and are only looked up for documents that others
propose, which loses no result: documents come by ascending doc_id, so an equal score later never wins. The k best
of all shards are merged by a window a query.

Terms are maximal runs of ASCII letters, digits and anything beyond ASCII; A to Z count as a to z. Null or empty text:
no terms; such a document is in no statistics and never found. A query without terms, or with none that a document has,
gives no rows. Very long texts are read whole. Rows that repeat a doc_id are documents of their own, and equal pairs
(score, doc_id) rank in no given order. Null doc_id: sorts after all others. Queries alike in id and text are one
query; queries that share an id only each give their rows. Other columns are not read. Empty tables: no rows.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import common

#: Bytes of text in a shard, queries in a block, results of a query.
SHARD_BYTES, BLOCK, K = 24 << 20, 256, 10
#: Fixed values of the contract's score.
TF_SCALE, TF_SHIFT, LENGTH_WEIGHT = 1_000_000_000, 8, 75


def table_of(more: str = "") -> bytes:
    """The byte table that turns A to Z into a to z and what parts terms into spaces; ``more``: ASCII characters that part terms too."""
    return bytes(32 if b < 128 and (not chr(b).isalnum() or chr(b) in more) else b + 32 if 65 <= b <= 90 else b for b in range(256))


TERMS = table_of()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of non-negative numbers, seven bits a byte, low bits first; and each one's length."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= 1 << 7 * k
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[start[own] + k] = (values[own] >> 7 * k & 127) | np.where(size[own] > k + 1, 128, 0)
    return out, size


def unpacked(code: bytes) -> np.ndarray:
    b = np.frombuffer(code, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, first)


#: term: null in the shard's own row; n: documents with the term; docs, tfs: variable-byte gaps and counts, or, in the shard's own row, ids and lengths as 8 bytes each.
INDEX = "shard string, term string, n long, total long, docs binary, tfs binary, no_id array<long>"


class Shard:
    """Gathers documents and gives their rows of the index."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, text: bytes | None) -> None:
        words = (text or b"").translate(TERMS).split()
        if words:
            known = self.words
            self.ids.append(doc)
            self.terms.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            self.size += len(text)

    def rows(self, name: str) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.array([len(self.terms[i]) for i in order], np.int64)
        place = np.repeat(np.arange(len(order)), lengths)
        pairs, tf = np.unique(np.concatenate([self.terms[i] for i in order]).astype(np.int64) * len(order) + place, return_counts=True)
        term, doc = pairs // len(order), pairs % len(order)
        cuts = common.group_starts(term)
        gap = np.diff(doc, prepend=0)
        gap[cuts[:-1]] = doc[cuts[:-1]]
        (docs, d), (tfs, t) = packed(gap), packed(tf)
        d, t = (np.append(0, np.cumsum(x))[cuts].astype(np.int32) for x in (d, t))
        as_lists = lambda raw, ends: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).to_pylist()
        names = [w.decode("utf-8", "replace") for w in self.words]  # in the order of their numbers
        ids = np.array([self.ids[i] or 0 for i in order], np.int64)
        columns = [
            pa.array([name] * (len(names) + 1)), pa.array([None, *names], pa.string()), pa.array(np.append(len(order), np.diff(cuts))), pa.array(np.append(lengths.sum(), np.add.reduceat(tf, cuts[:-1]))),
            pa.array([ids.tobytes(), *as_lists(docs, d)], pa.binary()), pa.array([lengths.tobytes(), *as_lists(tfs, t)], pa.binary()),
            pa.array([[k for k, i in enumerate(order) if self.ids[i] is None], *[None] * len(names)], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in INDEX.split(", ")])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index (INDEX) of ``docs``. Run it in ``common.small_batches``, and store it: a shard's name differs from run to run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        shard = Shard()
        for b in batches:
            for doc, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard.add(doc, words)
                if shard.size >= shard_bytes:
                    yield shard.rows(uuid.uuid4().hex)
                    shard = Shard()
        if shard.ids:
            yield shard.rows(uuid.uuid4().hex)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(run, INDEX)


class Postings:
    """One term in one shard: document numbers and what each scores."""

    __slots__ = ("docs", "scores", "top")

    def __init__(self, docs: bytes, tfs: bytes, length_part: np.ndarray, weight: int) -> None:
        doc, tf = np.cumsum(unpacked(docs)), unpacked(tfs)
        score = weight * (TF_SCALE * tf // (1000 * tf + TF_SHIFT * length_part[doc]))
        self.docs, self.scores, self.top = array("q", doc.tobytes()), array("q", score.tobytes()), int(score.max())


def best_of(lists: list[tuple[Postings, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, -document number) above 0, document at a time; lists: postings and how often the query has the term."""
    lists = sorted((p.top * times, times, p.docs, p.scores) for p, times in lists if p.top > 0)
    bound = [0]
    for top, *_ in lists:
        bound.append(bound[-1] + top)
    n = len(lists)
    bits = max(1, n.bit_length())
    mask, at, docs, scores, times = (1 << bits) - 1, [0] * n, [x[2] for x in lists], [x[3] for x in lists], [x[1] for x in lists]
    cursors = [docs[i][0] << bits | i for i in range(n)]
    heapq.heapify(cursors)
    best: list[tuple[int, int]] = []
    bar = first = 0  # a document counts if it scores more than bar; lists before first cannot reach that by themselves
    while cursors:
        doc = cursors[0] >> bits
        score = 0
        while cursors and cursors[0] >> bits == doc:
            i = cursors[0] & mask
            p = at[i]
            score += scores[i][p] * times[i]
            at[i] = p = p + 1
            if i >= first and p < len(docs[i]):
                heapq.heapreplace(cursors, docs[i][p] << bits | i)
            else:
                heapq.heappop(cursors)
        if score + bound[first] <= bar:
            continue
        for i in range(first - 1, -1, -1):
            if score + bound[i + 1] <= bar:
                break
            p = at[i] = bisect_left(docs[i], doc, at[i])
            if p < len(docs[i]) and docs[i][p] == doc:
                score += scores[i][p] * times[i]
        if score > bar:
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == k and best[0][0] > bar:
                bar = best[0][0]
                while first < n and bound[first + 1] <= bar:
                    first += 1
    return best


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(block, query, id, term, times) of every term of every query."""
    own = queries.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).distinct()
    own = common.stored(own.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-own.count() // BLOCK))
    own = own.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, w.decode("utf-8", "replace"), n) for i, t in enumerate(b.column(3).to_pylist()) for w, n in Counter((t or b"").translate(TERMS).split()).items()]
            if found:
                rows, terms, times = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(rows)) for k in range(3)), pa.array(terms), pa.array(times, pa.int64())], ["block", "query", "id", "term", "times"])

    kind = queries.schema[key].dataType.simpleString()
    return own.select("block", "query", "id", "text").mapInArrow(run, f"block long, query long, id {kind}, term string, times long")


def search(shards: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """(id, rank, doc, score): the k best documents of every query above score 0. shards: a stored ``index``. Run it in ``common.small_batches``."""
    terms = common.stored(query_terms(queries, key, text), "terms")
    wanted = terms.select("term").distinct()
    about = shards.where("term is null").agg(F.sum("n").alias("all_docs"), F.sum("total").alias("all_terms"))
    lists = shards.where("term is not null").join(common.small(common.stored(wanted, "wanted")), "term")
    lists = common.stored(lists.select("shard", "term", "n", "docs", "tfs"), "lists")
    weigh = F.floor(1000 * F.log((2 * F.col("all_docs") + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = common.stored(lists.groupBy("term").agg(F.sum("n").alias("df")).join(F.broadcast(about)).select("term", weigh.alias("weight")), "weights")
    # a term goes once to a block, with the queries of the block that have it
    asked = terms.join(weights, "term").groupBy("block", "term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("query", "times")).alias("queries"))
    asked = common.stored(asked, "asked")
    cells = lists.join(common.small(asked), "term").select("shard", "block", F.lit(1).alias("kind"), "docs", "tfs", "weight", "queries", F.lit(None).cast("array<long>").alias("no_id"), F.lit(0).cast("long").alias("all_docs"), F.lit(0).cast("long").alias("all_terms"))
    blocks = terms.select("block").distinct()
    own = shards.where("term is null").join(F.broadcast(blocks)).join(F.broadcast(about))  # as many blocks as BLOCK queries make
    none = F.lit(None).cast("array<struct<query:bigint,times:bigint>>")
    own = own.select("shard", "block", F.lit(0).alias("kind"), "docs", "tfs", F.lit(0).cast("long").alias("weight"), none.alias("queries"), "no_id", "all_docs", "all_terms")
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.union(cells).repartition(n, "shard", "block").sortWithinPartitions("shard", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, nulls, length_part, lists = None, None, set(), None, {}

        def result() -> Iterator[pa.RecordBatch]:
            found = [(q, None if -d in nulls else int(ids[-d]), s) for q, own in lists.items() for s, d in best_of(own, k)]
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query", "doc", "score"])

        for b in batches:
            for r in b.to_pylist():
                if (r["shard"], r["block"]) != cell:
                    yield from result()
                    cell, lists = (r["shard"], r["block"]), {}
                if r["kind"] == 0:
                    ids, nulls = np.frombuffer(r["docs"], np.int64), set(r["no_id"])
                    length_part = 100 - LENGTH_WEIGHT + LENGTH_WEIGHT * np.frombuffer(r["tfs"], np.int64) * r["all_docs"] // r["all_terms"]
                elif r["weight"] > 0:
                    p = Postings(r["docs"], r["tfs"], length_part, r["weight"])
                    for q in r["queries"]:
                        lists.setdefault(q["query"], []).append((p, q["times"]))
        yield from result()

    found = dealt.mapInArrow(run, "query long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(common.small(common.stored(terms.select("query", "id").distinct(), "ids")), "query").select("id", "rank", "doc", "score")


def op12_heap_merge(spark, sf_dir: str) -> DataFrame:
    with common.temporary() as keep, common.small_batches(spark):
        shards = common.stored(index(common.table(spark, sf_dir, "documents")), "shards")
        found = search(shards, common.table(spark, sf_dir, "benchmark"))
        return keep(common.stored(found.select(F.col("id").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score"), "found"))


QUERIES = {"op12_heap_merge": op12_heap_merge}
ORACLE_SQL = {
    "op12_heap_merge": r"""
with d as (select doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from documents),
p as (select doc_id, term, count(*) as tf from d group by all),
l as (select doc_id, sum(tf)::bigint as n from p group by all),
a as (select count(*) as docs, sum(n)::bigint as total from l),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, a group by term, docs),
m as (select doc_id, 25 + (75 * n * docs) // total as m from l, a),
i as (select distinct item_id, text from benchmark),
q as (select item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from i),
t as (select item_id, term, count(*) as times from q group by all),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from t join w using (term) join p using (term) join m using (doc_id) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10"""
}
