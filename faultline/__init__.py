"""Change-impact analytics on Spark."""
