"""Operators of the document-structure engine."""
