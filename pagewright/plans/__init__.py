"""Plans of the document-structure engine."""
