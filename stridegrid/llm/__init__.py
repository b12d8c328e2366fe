"""Operators for training-data pipelines: quality, dedup, packing, extraction, search."""
