"""Sequence analytics as Spark jobs."""
