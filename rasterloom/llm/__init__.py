"""Training-data operators: deduplication, filtering, tokenising and scoring of document tables.

Nothing outside this subpackage imports it.
"""
