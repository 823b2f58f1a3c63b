"""tallyforge: a PySpark-native analytics engine for adaptive-learning data."""
