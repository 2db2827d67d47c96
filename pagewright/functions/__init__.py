"""Functions of the document-structure engine."""
