"""Scalar functions and fixed tables."""
