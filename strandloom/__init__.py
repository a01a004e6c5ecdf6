"""PySpark-native realignment analytics."""
