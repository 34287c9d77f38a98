"""Operators for building training corpora: scoring, filtering, deduplication, tokenisation and scans.

Nothing else in the library imports this subpackage.
"""
