"""Column functions: plain builders over built-in Spark expressions."""
