"""Operators for preparing training corpora: packing, filtering, near-dedup, tokenising, sharding."""
