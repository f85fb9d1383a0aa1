"""Table-level operators: a DataFrame and column names in, a tidy DataFrame out."""
