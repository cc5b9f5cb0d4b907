"""Product-catalog data work on Spark: feeds, quality checks, prices, content."""
