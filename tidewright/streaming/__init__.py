"""Structured Streaming: windowed counts, deduplication, and merges into tables."""
