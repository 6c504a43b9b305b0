"""Column functions: text, vectors, spans and scores."""
