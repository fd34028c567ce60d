"""A PySpark-native engine that makes unknown tables answerable."""
