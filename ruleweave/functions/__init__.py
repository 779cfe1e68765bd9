"""Column expressions: packed keys, items, vectors, URLs, HTML and codes."""
