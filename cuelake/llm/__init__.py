"""Operators of a training-data pipeline over documents, conversations, pages and embeddings."""
