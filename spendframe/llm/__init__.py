"""Operators of a training-data pipeline: scans, models, deduplication, archives and tokenization."""
