"""A Spark-native engine for fund look-through analytics."""
