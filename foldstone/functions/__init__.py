"""Column expressions: scalar helpers and the derived-feature catalogue."""
