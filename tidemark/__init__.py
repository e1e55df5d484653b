"""A Spark-first engine for normalising, reconciling and rolling up scraped records."""
