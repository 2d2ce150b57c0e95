"""Operators for building training data: language, toxicity, duplicates, tokens, secrets, pages
and archives. Nothing else in the library imports this package."""
