"""Registered queries, by family. Importing this package fills the registry."""

from . import corpus_queries, metric_queries, python_queries, ranking_queries, retrieval_queries, sample_queries, source_queries, span_queries, text_queries, vector_queries  # noqa: F401
