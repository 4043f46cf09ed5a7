"""Operators for training-data pipelines: deduplication, token work, search, mixing, archives, quality, extraction."""
