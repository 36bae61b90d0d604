"""Filtered vector search on Spark: exact and approximate top-K among the rows that a structured predicate admits."""
