"""A Spark-native engine for retrieval, structure and compliance analytics over document collections."""
