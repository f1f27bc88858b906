"""Operators for building training corpora: tokens, near-duplicates, filters, shards, archives."""
