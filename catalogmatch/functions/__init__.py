"""Column functions: geometry, filters, text, vectors."""
