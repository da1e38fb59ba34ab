"""Operators of a training-data pipeline: deduplication, packing, extraction, filtering and scoring of text."""
