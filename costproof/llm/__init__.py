"""Operators of a training-data pipeline over documents, embeddings and pages.

Nothing else in the library imports this package.
"""
