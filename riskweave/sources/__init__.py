"""Sources of the code-risk engine."""
