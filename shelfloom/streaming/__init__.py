"""Structured Streaming forms of the feed and price jobs."""
