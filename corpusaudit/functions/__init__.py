"""Column expressions: text, paths, vectors, severities."""
