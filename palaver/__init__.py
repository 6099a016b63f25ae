"""A PySpark-native engine for conversation corpora."""
