"""codeweft: a PySpark-native analytics engine for code-structure graphs."""
