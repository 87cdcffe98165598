"""Functions of the code-risk engine."""
