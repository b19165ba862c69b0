"""Operators for training-data corpora: filters, deduplication, packing and formats."""
