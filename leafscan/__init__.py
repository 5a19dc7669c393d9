"""Page-text analytics on Spark."""
