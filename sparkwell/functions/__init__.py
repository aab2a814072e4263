"""Scalar functions as Column expressions, where Spark has no function of that name."""
