"""Market-data analytics on Spark."""
