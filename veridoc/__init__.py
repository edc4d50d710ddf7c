"""PySpark-native analytics over document and quote evidence."""
