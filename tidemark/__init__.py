"""Point-in-time analytics on Spark: bars, causal features, labels, evaluation and streams."""
