"""Corpus preparation for language models: quality, safety, deduplication, mixing and packing.

Nothing outside this subpackage imports it.
"""
