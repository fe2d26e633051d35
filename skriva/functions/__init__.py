"""Scalar functions, stemming and tagging."""
