"""Column helpers: Column in, Column out, all built-in expressions."""
