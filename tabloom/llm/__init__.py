"""Operators for training-data corpora: scoring, near duplicates, tokenizers, filters, mixing, search.

Nothing else in the library imports this subpackage; ``catalog`` holds its registered queries.
"""
