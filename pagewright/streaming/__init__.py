"""Streaming of the document-structure engine."""
