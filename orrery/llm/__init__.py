"""Training-data operators: archives, sharding, near-duplicates, mixing, scoring, tokenising.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
