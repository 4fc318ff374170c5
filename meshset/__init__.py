"""A query engine for versioned topology graphs on Spark."""
