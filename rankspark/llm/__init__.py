"""Operators for building training corpora: filters, deduplication, mixing, sharding, scoring, search."""
