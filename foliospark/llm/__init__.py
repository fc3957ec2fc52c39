"""Training-data operators: deduplication, sharding, scoring, packing, filtering and chat formatting.

Nothing outside this package (and corpus_pipeline.py) imports it.
"""
