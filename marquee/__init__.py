"""Recommendation analytics as Spark DataFrame jobs."""
