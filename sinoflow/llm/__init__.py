"""Operators of a training-data pipeline: tokens, deduplication, filters and privacy.

Nothing outside this package imports it.
"""
