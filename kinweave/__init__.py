"""A PySpark-native record-linkage engine; see README.md."""
