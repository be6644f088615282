"""Quayline: logistics-operations analytics as Spark DataFrame jobs."""
