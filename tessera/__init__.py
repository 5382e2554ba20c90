"""Spark-first analytics for building and studying labelled text corpora."""
