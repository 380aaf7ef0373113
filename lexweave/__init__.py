"""A PySpark-native engine for evidence retrieval over document collections."""
