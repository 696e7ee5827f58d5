"""Corpus preparation for training data: filters, deduplication, mixing, packing."""
