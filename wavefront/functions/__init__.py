"""Scalar functions: random numbers, ids, codes."""
