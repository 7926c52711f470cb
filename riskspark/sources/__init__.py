"""riskspark.sources."""
