"""Spark jobs for two-sided event data: ingestion, as-of features, ratings, models, audits, streams."""
