"""Spark-first analytics for documents aligned to goals, and for corpora."""
