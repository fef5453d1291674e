"""Operators of a training-data pipeline: dedup, filters, formatting and packing of text corpora.

Nothing outside this subpackage imports it.
"""
