"""Spark-first sequence analytics."""
