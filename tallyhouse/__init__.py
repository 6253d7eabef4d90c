"""Cross-service analytics on Spark: one organisation, three services, one set of people."""
