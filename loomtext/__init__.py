"""Text analytics over document corpora, expressed as Spark DataFrame operations."""
