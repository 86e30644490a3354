"""Each stage against a brute-force version on a small fixture, and the whole."""

import hashlib

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, prose


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    passage = prose(900, 60) + "."
    rows = [(k, prose(k, 120), "en", f"s{k % 3}", 0) for k in range(30)]
    rows += [(40, prose(3, 120), "en", "s1", 0), (41, "## " * 80, "en", "s1", 0), (42, "few words", "en", "s2", 0), (43, prose(43, 70) + ". " + passage, "en", "s0", 0), (44, prose(44, 70) + ".\n" + passage, "en", None, 0), (45, None, None, None, None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
    return str(d), rows, passage


def test_stages(spark, sf):
    d, rows, passage = sf
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    a = P.quality_rules(spark, docs, d)
    assert a.columns == columns and {r.doc_id for r in a.collect()} == {*range(30), 40, 43, 44}
    b = P.simhash_near_dedup(spark, a, d)
    assert b.columns == columns and {r.doc_id for r in b.collect()} == {*range(30), 43, 44}
    c = P.substring_dedup(spark, b, d)
    text = {r.doc_id: r.text for r in c.collect()}
    assert c.columns == columns and passage in text[43] and passage not in text[44] and all(text[k] == rows[k][1] for k in range(30))
    assert all(r.n_chars == len(r.text) for r in c.collect())
    m = P.source_mix(spark, c, d)
    assert m.columns == columns
    words = lambda df, s: sum(len(r.text.split()) for r in df.collect() if r.source == s)
    total = sum(len(t.split()) for t in text.values())
    assert abs(sum(words(m, s) for s in ("s0", "s1", "s2", None)) - 1.5 * total) <= 4 * 70
    e = P.byte_bpe(spark, m, d)
    whole = {hashlib.sha256(t.encode()).hexdigest() for t in text.values()}
    assert e.count() == m.count() and {r.decoded_sha256 for r in e.collect()} <= whole


def test_run(spark, sf):
    d, _, _ = sf
    a, b = P.run(spark, d), P.run(spark, d)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 30
    assert [n for n, _ in P.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "source mix", "byte bpe"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
