"""Operators that prepare training text: archives, tokens, duplicates, quality."""
