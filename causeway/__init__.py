"""Spark-native engine for causal-graph extraction and evaluation over text corpora."""

__version__ = "0.1.0"
