"""A Spark-native engine for exact similarity search over fixed-length series."""
