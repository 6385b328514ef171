"""Column-level functions: packed-string parsers, row expressions and text tokens."""
