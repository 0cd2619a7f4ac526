"""Scalar and column helpers."""
