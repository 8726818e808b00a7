"""Market analytics on Spark: ingest, conform, query and monitor agricultural price and supply bulletins."""
