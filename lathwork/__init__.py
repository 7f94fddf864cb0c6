"""Analytics on building models and other hierarchical, geometric data, as Spark DataFrame operations."""
