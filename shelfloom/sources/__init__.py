"""Feeds, marketplace pages and stored tables."""
