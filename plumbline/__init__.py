"""Corpus integrity analytics as Spark jobs."""
