"""Spark-first analytics over versioned JSON entities."""
