"""A versioned key-value log on Spark: an append-only relation (key, seq, value) whose null values are tombstones."""
