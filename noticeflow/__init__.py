"""PySpark-native operators for purchase notices and similar listings."""
