"""DataFrame operators: each takes and returns DataFrames and leaves physical choices to Spark."""
