"""Column functions: everything here is a plain Catalyst expression, no Python runs per row."""
