"""Corpus preparation operators: deduplication, tokenising, filters, mixing, archives and language-model scores.

Nothing outside this subpackage imports it.
"""
