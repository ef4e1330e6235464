"""Incremental view maintenance on PySpark, and an optional set of corpus operators."""
