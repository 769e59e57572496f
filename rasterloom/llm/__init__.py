"""Training-data operators: scoring, tokenizing, search, deduplication, filtering and mixing.

Nothing outside this subpackage (but ``corpus_pipeline.py``) imports it.
"""
