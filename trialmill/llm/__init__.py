"""Operators for preparing text corpora: deduplication, filtering, formatting, mixing, search and tokenising."""
