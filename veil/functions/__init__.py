"""Column expressions: canonical text, keyed digests and draws, row methods."""
