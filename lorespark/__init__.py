"""A PySpark-native engine for traceable document knowledge."""
