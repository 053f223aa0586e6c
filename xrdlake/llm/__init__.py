"""Operators for preparing text corpora: deduplication, filtering, formatting, packing."""
