"""Document, event, graph and interval analytics on Spark, for loosely structured, access-controlled data."""
