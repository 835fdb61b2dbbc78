"""Document-audit analytics on Spark."""
