"""keyloom: versioned, ordered key-value analytics as PySpark DataFrames."""
