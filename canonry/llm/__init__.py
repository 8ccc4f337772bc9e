"""Operators for training-data pipelines: scoring, deduplication, filtering, formatting and packing.

Nothing outside this subpackage imports it.
"""
