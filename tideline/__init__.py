"""Ordered-stream, signal and text analytics as PySpark operators."""
