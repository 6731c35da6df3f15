"""A PySpark-native analytics engine: DataFrame, SQL and Structured Streaming."""
