"""Spark-first analytics over time-stamped events, prices and text."""
