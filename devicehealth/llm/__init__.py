"""Operators of a training-data pipeline over documents, vectors and conversations; nothing else in the library imports them."""
