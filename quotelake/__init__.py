"""Market-data analytics as DataFrame-in, DataFrame-out Spark operators."""
