"""Where tables come from: versioned Parquet, other databases."""
