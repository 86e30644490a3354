"""The training-data pipeline: five stages over ``documents``, each written and read again as Parquet.

Every stage reads the whole of what the one before it kept. All but the last return the columns of
documents; the last returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of every reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bpe, common, mixing, paragraphs, quality, simhash


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that a rule rejects go."""
    return quality.filtered(docs)


def simhash_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on five-word shingles: of each group of near-duplicates the document with the smallest id stays."""
    return simhash.representatives(docs)


def substring_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: paragraphs that an earlier document keeps are cut out; documents that lose every word go."""
    kept = paragraphs.removed(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def source_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents repeat or go as their source's target asks, in training order."""
    return mixing.curriculum(docs)


def byte_bpe(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every reading is encoded and decoded."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("source mix", source_mix),
    ("byte bpe", byte_bpe),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs, f"stage{k}")
    return docs


#: Fingerprint components, verified Jaccard and merges cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
