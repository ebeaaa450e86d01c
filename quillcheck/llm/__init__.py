"""Operators for large training-data pipelines.

Nothing outside this subpackage (but ``__spark_entry__`` and ``corpus_pipeline``) imports it.
"""
