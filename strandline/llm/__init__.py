"""Operators that prepare text and embeddings for model training; nothing else in the library imports this package."""
