"""Operators for training-data corpora: detection, deduplication, packaging, encoding and sampling."""
