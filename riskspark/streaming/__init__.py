"""riskspark.streaming."""
