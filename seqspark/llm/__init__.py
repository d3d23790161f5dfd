"""Training-data operators: ten methods, their queries and SQL."""
