"""A Spark-native vector store with charts, metrics and geodesics."""
