"""Training-data operators: filtering, deduplication, packing and encoding of text corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it can be removed whole.
"""
