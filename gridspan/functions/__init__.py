"""Column functions: array semantics as Spark expressions."""
