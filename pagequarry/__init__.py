"""Page-capture analytics on Spark: request batches and captured responses as tables."""
