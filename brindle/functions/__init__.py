"""Scalar functions of the query dialect, as Column expressions."""
