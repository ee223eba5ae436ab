"""Versioned key-value analytics on PySpark: reads, merges and changes over a multi-version log held as a DataFrame."""
