"""Search inside documents with Spark."""
