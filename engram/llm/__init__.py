"""Operators for building training data: one module per operator, plus their queries.

Nothing outside this folder, ``corpus_pipeline.py`` and the optional part of
``__spark_entry__.py`` imports it.
"""
