"""Sources of the document-structure engine."""
