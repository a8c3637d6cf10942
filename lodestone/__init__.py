"""Spark-first analytics over code snapshots and training corpora."""

__version__ = "0.1.0"
