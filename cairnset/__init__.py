"""cairnset: a Spark-native engine for code, memory-note and training-data analytics."""
