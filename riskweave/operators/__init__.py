"""Operators of the code-risk engine."""
