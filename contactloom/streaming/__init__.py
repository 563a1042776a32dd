"""Bounded batches out of datasets, and ordered ingestion into them."""
