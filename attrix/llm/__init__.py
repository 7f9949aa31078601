"""Operators of a training-data pipeline (deduplication, tokens, packing,
search, language ID).  Nothing outside this subpackage imports it."""
