"""Mobility exposure analytics as Spark DataFrame jobs."""
