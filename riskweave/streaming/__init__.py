"""Streaming of the code-risk engine."""
