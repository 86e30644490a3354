"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has a bit set where over half its shingle hashes have it. Fingerprints link at
``radius`` or fewer differing bits; documents that are linked, directly or by way of others, form a
component.

Hamming distance obeys the triangle inequality: if two fingerprints differ in at most r bits, their
distances to any reference fingerprint differ by at most r. So each distinct fingerprint's distances to many
seeded references (pivots) are tabled once and travel with it; a pair is discarded as soon as one coordinate
of the table differs by more than r, and only the survivors are verified bit by bit.

The table discards pairs; it needs a source of pairs that is not all of them. Fingerprints are cut
into blocks so that any two within r agree in some choice of blocks, and only those that share such a
choice meet. How many blocks are cut follows from the number of distinct fingerprints, so that a
bucket holds a bounded number on average; the links found are the same for any cut. A bucket of more
than ``CHUNK`` is dealt out as pairs of chunks. A bucket emits a spanning forest, never all its pairs.

Null or empty text and text without words: fingerprint zero, linked like any other. Very long texts
are hashed whole, in blocks. Repeated rows and equal fingerprints are one node. A null key is carried
along but never names a component. Empty table: no rows. Other columns pass through where asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from orrery.llm import common, paragraphs

#: Reference fingerprints of the distance table, drawn with this seed.
PIVOTS, PIVOT_SEED = 32, 7
#: Distinct fingerprints in a bucket: on average at most, and before it is dealt out in chunks.
BUCKET, CHUNK = 256, 1024
#: Keys in a partition on average, at most.
PART_KEYS = 500_000
#: MinHash bands that propose near-duplicates besides: of pairs at ``paragraphs.SIMILARITY`` 0.998 share one.
BANDS, ROWS = 16, 5
_rng = np.random.default_rng(2025)
FACTORS = _rng.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
SHIFTS = _rng.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each window of ``words`` words, A-Z in lower case, joined by one space."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = [e + i for i, e in enumerate(accumulate(map(len, w)))]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :] or ends[-1:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint; bit i is 1 if set in over half of ``hashes``."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Signed keys of the MinHash bands of a text's shingle hashes; none without hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096] * FACTORS + SHIFTS).min(1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = paragraphs.mixed(key * paragraphs.BASE + row)
    return key.view(np.int64)


def fingerprinted(docs: DataFrame, passing: tuple[str, ...], text: str = "text", words: int = 4, name: str = "fp", bands: str | None = None) -> DataFrame:
    """The columns ``passing`` and ``name``: each text's fingerprint as a long; and ``bands``, where named: its MinHash bands."""
    common.text_batches(docs.sparkSession)
    keep = [c for c in passing if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, keys = [], []
            for t in b.column(0).to_pylist():
                hashes = shingle_hashes(t, words)
                found.append(fingerprint(hashes))
                if bands:
                    keys.append(band_keys(hashes))
            more = {name: pa.array(found, pa.int64())} | ({bands: pa.array(keys, pa.list_(pa.int64()))} if bands else {})
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *more.values()], [*b.schema.names[1:], *more])

    schema = StructType([*docs.select(*keep).schema.fields, StructField(name, LongType()), *([StructField(bands, ArrayType(LongType()))] if bands else [])])
    return docs.select(F.col(text).alias("_text_to_hash"), *keep).mapInArrow(run, schema)


def cut(count: int, radius: int) -> tuple[int, int]:
    """(blocks, blocks that must agree) for ``count`` fingerprints: the fewest with at most ``BUCKET`` in a bucket on average."""
    agree = 1
    while count > BUCKET * 2 ** (64 * agree / (radius + agree)) and radius + agree < 64:
        agree += 1
    return radius + agree, agree


def bucket_choices(count: int, radius: int) -> list[int]:
    """Bit masks of every choice of blocks that must agree; fingerprints within ``radius`` agree under at least one."""
    blocks, agree = cut(count, radius)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(blocks), agree)]


def bucket_keys(fp: Column, count: int, radius: int) -> Column:
    """Keys such that fingerprints within ``radius`` share at least one."""
    signed = [m - (1 << 64) if m >> 63 else m for m in bucket_choices(count, radius)]
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)))


def pivots() -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, PIVOTS, np.uint64)


def tabled(fps: DataFrame) -> DataFrame:
    """(fp, table): each fingerprint's distances to the pivots, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = pivots()[None, :]
        for b in batches:
            fp = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ marks)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(fp), [None, pa.py_buffer(table.tobytes())]).cast(pa.binary())], ["fp", "table"])

    return fps.select("fp").mapInArrow(run, "fp long, table binary")


def linked(fps: np.ndarray, table: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of the first one it is linked to, directly or not, in its group; ``ends``: where its group ends."""
    forest = common.Forest(len(fps))
    i, step = np.arange(len(fps)), 1
    while (i := i[i + step < ends[i]]).size:
        root = forest.root
        a = i[root[i] != root[i + step]]
        for p in range(0, PIVOTS, 4):
            if not a.size:
                break
            a = a[np.abs(table[a, p : p + 4] - table[a + step, p : p + 4]).max(1) <= radius]
        if a.size:
            a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= radius]
        if a.size:
            forest.unite(a, a + step)
            forest.flatten()
        step += 1
    return forest.root


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): fingerprints within ``radius``, enough of them to connect all that are; ``fps``: one column fp, distinct, stored."""
    spark = fps.sparkSession
    count = fps.count()
    keyed = tabled(fps).withColumn("key", F.explode(bucket_keys(F.col("fp"), count, radius)))
    sizes = fps.select(F.explode(bucket_keys(F.col("fp"), count, radius)).alias("key")).groupBy("key").count()
    large = common.stored(sizes.where(F.col("count") > CHUNK), "large")
    keyed = keyed.join(large, "key", "left")
    chunks = F.ceil(F.col("count") / CHUNK)
    own = F.pmod(F.xxhash64("fp"), chunks)
    keyed = keyed.withColumn("_own", own).withColumn("_other", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (chunks - 1).cast("int")))))
    keyed = keyed.where("count is null or _own <> _other").withColumn("deal", F.when(F.col("count").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * len(bucket_choices(count, radius)) // PART_KEYS))
    dealt = keyed.select("deal", "fp", "table").repartition(parts, "deal").sortWithinPartitions("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.keyed_runs(batches, ["deal"]):
            key, fp = whole.column("deal").to_numpy(), whole.column("fp").to_numpy()
            table = np.frombuffer(b"".join(whole.column("table").to_pylist()), np.int8).reshape(-1, PIVOTS)
            starts = common.group_starts(key)
            root = linked(fp.astype(np.int64).view(np.uint64), table, np.repeat(starts[1:], np.diff(starts)), radius)
            child = np.flatnonzero(root != np.arange(len(root)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(key, fp, component_id) of every row: component_id is the smallest key reachable by links."""
    with common.temporary() as keep:
        rows = keep(common.stored(fingerprinted(docs, (key,), text, words).select(F.col(key).alias("key"), "fp"), "fingerprints"))
        least = common.stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "least")
        parts = common.stored(common.components(links(least.select("fp"), radius)), "components")
        named = parts.join(least, parts.node == least.fp).groupBy("root").agg(F.min("least").alias("component"))
        named = common.stored(named, "named")
        labels = common.stored(parts.join(named, "root").select(F.col("node").alias("fp"), "component"), "labels")
        final = keep(common.stored(least.join(labels, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "final"))
    return rows.join(final, "fp").select(F.col("key").alias(key), "fp", "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, its columns as they were: the one with the smallest key.

    Fingerprints within ``radius`` only propose, and so do equal MinHash bands, as fingerprints of texts at the
    least similarity often differ by some 16 bits, a radius at which neither blocks nor pivots tell pairs apart: a link counts if the texts' sets of word shingles have a
    Jaccard similarity of ``paragraphs.SIMILARITY`` or more, which is verified exactly inside each
    component of proposed links and each band's bucket. Equal texts are always linked. Texts of fewer words than a shingle are
    near-duplicates only if their words are equal. Rows with a null key go only for rows with a key or an equal text.
    """
    text_id = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    with common.temporary() as keep:
        rows = fingerprinted(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), text_id.alias("content")), ("key", "content"), "text", words, bands="bands")
        banded = common.stored(rows, "fingerprints")
        rows = banded.drop("bands")
        each = common.stored(rows.groupBy("content", "fp").agg(F.min("key").alias("key")), "contents")
        fps = common.stored(each.select("fp").distinct(), "fps")
        near = common.stored(common.components(links(fps, radius)), "proposed")
        grouped = each.join(near, each.fp == near.node, "left").select("content", "key", F.coalesce("root", "fp").alias("bucket"))
        many = common.stored(grouped.groupBy("bucket").count().where("count > 1").select("bucket"), "many")
        sharing = paragraphs.colliding(banded.select("content", "bands", F.col("content").alias("doc")).dropDuplicates(["content"]))
        buckets = common.stored(grouped.select("content", "bucket").join(many, "bucket").select("bucket", "content").union(sharing), "buckets")
        members = common.stored(each.join(buckets.select("content").distinct(), "content").select("content", "key"), "members")
        own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), text_id.alias("content")).alias("d")
        own = own.join(common.small(members).alias("m"), F.col("d.key").eqNullSafe(F.col("m.key")) & (F.col("d.content") == F.col("m.content"))).select("text", "d.content")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [np.unique(h).tobytes() if len(h := shingle_hashes(t, words)) else b"" for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.binary())], ["content", "set"])

        sets = own.mapInArrow(run, "content long, set binary").withColumns({"lo": F.col("content"), "hi": F.col("content")})
        parts = common.stored(common.components(paragraphs.links(buckets, sets)), "verified")
        placed = rows.join(parts, rows.content == parts.node, "left").select("key", "content", F.coalesce("root", "content").alias("group"))
        placed = common.stored(placed, "placed")
        first = F.struct(F.col("key").isNull(), "key", "content")
        stays = common.stored(placed.groupBy("group").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", F.col("first.key").alias("first_key"), F.col("first.content").alias("first_content")), "stays")
        inside = placed.join(stays, "group")
        stay = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("content") == F.col("first_content"))
        goes = keep(common.stored(inside.where(~stay).select("key", "content").distinct(), "goes"))
        twice = keep(common.stored(inside.where(stay).groupBy("key", "content").count().where("count > 1").select("key", "content"), "twice"))
    named, content = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}, "_content"
    whole = docs.withColumn(common.free_name(docs, content), text_id).withColumnsRenamed(named).withColumnsRenamed({common.free_name(docs, content): content})
    same = F.col(named[key]).eqNullSafe(F.col("key")) & (F.col(content) == F.col("content"))
    whole = whole.join(common.small(goes), same, "left_anti")  # texts stay where they are if few go
    if not twice.isEmpty():  # rows that repeat key and text of the one that stays
        again = whole.join(twice, same, "left_semi").dropDuplicates([named[key], content])
        whole = whole.join(twice, same, "left_anti").unionByName(again)
    return whole.select(*(F.col(new).alias(old) for old, new in named.items()))


def op3_simhash_pivots(spark, sf_dir: str) -> DataFrame:
    rows = near_duplicates(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_pivots": op3_simhash_pivots}
ORACLE_SQL = {}
