"""Operators for large training-data corpora: filters, deduplication, decontamination, tokens and shards."""
