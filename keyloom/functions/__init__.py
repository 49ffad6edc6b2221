"""Column builders: everything stays a native Spark expression."""
