"""Code-risk analytics on Spark."""
