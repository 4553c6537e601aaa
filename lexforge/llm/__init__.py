"""Operators for preparing training data: tokenising, sharding, deduplication, mixing, archives, filtering.

Nothing outside this folder (but ``__spark_entry__.py``, which guards the import) depends on it.
"""
