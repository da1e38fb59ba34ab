"""Structured Streaming forms of queries whose input arrives over time."""
