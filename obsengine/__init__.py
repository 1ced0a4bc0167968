"""PySpark-native analytics over tracked observations."""
