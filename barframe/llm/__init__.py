"""Training-data operators: each one reads and returns DataFrames and scales by partition."""
