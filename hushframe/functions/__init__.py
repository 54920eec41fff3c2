"""Column functions: text, spans and hashes."""
