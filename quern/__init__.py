"""A Spark-native engine for a layered, federated document store."""
