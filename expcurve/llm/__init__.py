"""Operators of a training-data pipeline, each written for Spark at scale.

Nothing outside this package imports it, apart from the registration guard
in ``__spark_entry__`` and ``corpus_pipeline``.
"""
