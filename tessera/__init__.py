"""Catalogue matching analytics on Spark: ingest, merge, publish, search, resolve and stream."""
