"""User-defined functions: a vectorised scalar one, a grouped aggregate, a table function, and the encoder and generator protocols."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from orrery.sources.tables import table


class Encoder(Protocol):
    """Texts to vectors, one batch at a time; a real model plugs in here."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Deterministic stand-in: a seeded normal vector by the text's digest, unit length if asked."""

    def __init__(self, dim: int = 64, prefix: str = "", normalize: bool = True) -> None:
        self.dim, self.prefix, self.normalize = dim, prefix, normalize

    def __call__(self, texts: list[str]) -> np.ndarray:
        seeds = (int.from_bytes(hashlib.blake2b((self.prefix + t).encode(), digest_size=8).digest(), "little") for t in texts)
        out = np.stack([np.random.default_rng(s).normal(size=self.dim) for s in seeds])
        return out / np.linalg.norm(out, axis=1, keepdims=True) if self.normalize else out


def encoded(rows: DataFrame, encoder: Encoder, key: str, text: str) -> DataFrame:
    """(key, v): the encoder over Arrow batches; null texts as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = encoder([t or "" for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], [key, "v"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, v array<double>")


def instructed(kind: str, query: bool) -> Callable:
    """Instruction before a text, as the encoder's family asks."""
    heads = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}
    head = heads.get(kind, ("", ""))[not query]
    return lambda x: F.concat(F.lit(head), x)


@F.pandas_udf(LongType())
def vowels(x: pd.Series) -> pd.Series:
    return x.str.count("[aeiouAEIOU]").fillna(0).astype("int64")


@F.pandas_udf(DoubleType())
def geometric_mean(x: pd.Series) -> float:
    """Over 1 + |x|."""
    return float(np.exp(np.log1p(x.abs()).mean()))


@F.udtf(returnType="piece int, text string")
class Chunks:
    """Pieces of at most ``size`` words."""

    def eval(self, text: str, size: int):
        words = (text or "").split()
        for k in range(0, len(words), size):
            yield k // size, " ".join(words[k : k + size])


def q_udf_scalar(spark, d):
    return table(spark, d, "documents").select("doc_id", vowels("text").alias("vowels"))


def q_udaf_grouped(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(geometric_mean("value").alias("g")).select("event_type", F.round("g", 6).alias("geo"))


def q_udtf_chunker(spark, d):
    spark.udtf.register("orrery_chunks", Chunks)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("select doc_id, c.piece, md5(c.text) as md5 from {docs} as docs, lateral orrery_chunks(docs.text, 100) as c", docs=docs)


def q_hash_encoder(spark, d):
    docs = table(spark, d, "documents").select("doc_id", instructed("e5", False)(F.substring_index("text", "\n", 1)).alias("t"))
    v = encoded(docs, HashEncoder(64), "doc_id", "t")
    return v.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


QUERIES = {"udf_scalar": q_udf_scalar, "udaf_grouped": q_udaf_grouped, "udtf_chunker": q_udtf_chunker, "hash_encoder": q_hash_encoder}
ORACLE_SQL = {
    "udf_scalar": "select doc_id, length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g'))::bigint as vowels from documents",
    "udaf_grouped": "select event_type, round(exp(avg(ln(1 + abs(value)))), 6) as geo from events group by 1",
    "udtf_chunker": r"with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') as w from documents), p as (select doc_id, w, unnest(range((len(w) + 99) // 100))::int as piece from w) select doc_id, piece, md5(array_to_string(w[piece * 100 + 1 : piece * 100 + 100], ' ')) as md5 from p",
    "hash_encoder": "select doc_id, 64 as dim, 1.0::double as norm2 from documents",
}
