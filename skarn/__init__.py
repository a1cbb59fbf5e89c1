"""Corpus search, ranking and ingest engine expressed as Spark DataFrame plans."""
