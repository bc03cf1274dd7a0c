"""A text-memory analytics engine on Spark."""
