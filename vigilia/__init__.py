"""Service-continuity analytics on Spark: outage data in, indicators and compensation out."""
