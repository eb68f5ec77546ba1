"""A PySpark-native engine for explainable retrieval over a property graph."""
