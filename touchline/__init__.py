"""PySpark-native event analytics."""
