"""Operators for preparing text corpora: quality, joins, privacy, shards, tokens, search."""
