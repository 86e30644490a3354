"""Two-pass external shuffle into shards.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash of key and text.
Pass two takes one bucket at a time, Fisher-Yates shuffles it with a generator seeded by (seed,
bucket), and writes it. The order of all records is bucket after bucket; shards are equal ranges of
that order, so their counts are at most one apart (law ``rows``) and a bucket feeds one or two shards.

Reruns agree: a bucket is sorted by key and a hash of all columns before it is shuffled, so neither the order of
arrival nor a retried task changes the outcome.

Null key: the text's hash stands in. Null text: size 1, checksum 0. Repeated rows are kept, each with
a slot of its own; rows that agree in key and text share a bucket. Empty table: no rows. Input columns
pass through whole, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orrery.llm import common

#: Bytes of text in a bucket, on average at most.
BUCKET_BYTES = 16 << 20
#: So many bucket offsets (16 bytes each) are broadcast at most; beyond, they are joined.
BROADCAST_BUCKETS = 200_000


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    """A uniform permutation of 0..n-1: from the end, each place is swapped with one at or before it."""
    order = list(range(n))
    draws = rng.integers(0, np.arange(1, n + 1)).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def two_pass_shuffle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str]:
    """The rows of ``docs`` and their place (0-based, gapless) in the shuffled order, in a column whose name is returned too."""
    spark = docs.sparkSession
    common.text_batches(spark)
    place, bucket, tie, offset = (common.free_name(docs, x) for x in ("_place", "_bucket", "_tie", "_offset"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.xxhash64(text)), F.lit(n))
    counts = docs.select(spread.alias(bucket)).groupBy(bucket).count()
    upto = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = common.stored(counts.select(bucket, F.coalesce(F.sum("count").over(upto), F.lit(0)).alias(offset)), "offsets")
    scattered = docs.withColumns({bucket: spread, tie: F.xxhash64(*(f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))}).join(F.broadcast(offsets) if n <= BROADCAST_BUCKETS else offsets, bucket)
    scattered = scattered.select(*docs.columns, bucket, offset, tie).repartition(n, bucket).sortWithinPartitions(bucket, key, tie)
    width = len(docs.columns)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.keyed_runs(batches, [bucket]):
            ids = whole.column(bucket).to_numpy()
            ends = common.group_starts(ids)
            for lo, hi in zip(ends, ends[1:], strict=False):
                part = whole.slice(lo, hi - lo)
                order = fisher_yates(len(part), np.random.default_rng([seed, int(ids[lo])]))
                first = part.column(offset)[0].as_py()
                for at in range(0, len(order), common.TEXT_ROWS):
                    piece = part.take(pa.array(order[at : at + common.TEXT_ROWS])).combine_chunks()
                    spot = pa.array(np.arange(first + at, first + at + len(piece)), pa.int64())
                    names = [*piece.schema.names[:width], place]
                    yield from pa.Table.from_arrays([*piece.columns[:width], spot], names).to_batches()

    return scattered.mapInArrow(shuffle, StructType([*docs.schema.fields, StructField(place, LongType())])), place


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """Writes the shuffled rows to ``path`` in folders shard=0.. and reads them back: the columns of ``docs``, slot and shard.

    Shard s holds places ceil(s * n / shards) .. and slots count from 0 in it. A column ``shard`` or
    ``slot`` of the input is kept under its name with ``in_`` before it.
    """
    docs = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns if c in ("shard", "slot")})
    n = docs.count()
    rows, place = two_pass_shuffle(docs, key, text, seed)
    rows = rows.withColumn("shard", F.expr(f"cast(`{place}` * {shards} div {max(n, 1)} as int)"))
    rows = rows.withColumn("slot", F.expr(f"`{place}` - (shard * {n}L + {shards - 1}) div {shards}")).drop(place)
    rows.write.partitionBy("shard").parquet(path)
    kept = rows.select(*docs.columns, "slot", "shard").schema
    return docs.sparkSession.read.schema(kept).option("basePath", path).parquet(path)


def op2_two_pass_shards(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rows = write_shards(docs, common.new_path(spark, "shards"), 8)
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_two_pass_shards": op2_two_pass_shards}
ORACLE_SQL = {}
