"""Spark-first analytics over token sequences and training corpora."""
