"""Column functions: identifiers, text, full text, vectors, dates."""
