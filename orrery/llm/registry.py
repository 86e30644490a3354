"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from orrery.llm import bpe, divergence, lines, mincut, mixing, paragraphs, quality, search, sharding, simhash, topk, toxicity, warc

MODULES = (warc, sharding, simhash, mixing, toxicity, bpe, paragraphs, mincut, quality, topk, lines, search, divergence)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
