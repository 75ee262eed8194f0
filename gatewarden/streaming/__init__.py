"""Structured Streaming stages: the same functions as in batch, over sources and sinks that are given."""
