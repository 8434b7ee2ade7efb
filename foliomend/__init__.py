"""Spark-native health gates and conservative repair for text layers of scanned collections."""
