"""A PySpark-native engine for panels of entities over time."""
