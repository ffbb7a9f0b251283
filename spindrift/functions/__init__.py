"""Scalar functions as Column expressions: vectors, text, identity."""
