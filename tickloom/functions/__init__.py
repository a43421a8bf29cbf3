"""Scalar functions: each returns a Column built from built-in expressions only."""
