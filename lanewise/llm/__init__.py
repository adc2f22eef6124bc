"""Operators for building training corpora: search, deduplication, cleaning, mixing and sharding."""
