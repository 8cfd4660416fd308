"""Column expressions and small driver helpers."""
