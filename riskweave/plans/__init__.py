"""Plans of the code-risk engine."""
