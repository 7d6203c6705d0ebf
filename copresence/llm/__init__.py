"""Operators of a training-data pipeline over documents, pages and vectors. Nothing else in the library imports this package."""
