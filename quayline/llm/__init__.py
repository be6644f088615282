"""Operators of a training-data pipeline: one module each, and `catalog` that registers their queries."""
