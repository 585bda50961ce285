"""Operators over the document index."""
