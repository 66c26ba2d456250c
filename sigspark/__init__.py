"""sigspark: a PySpark-native analytics engine for sampled signals and event streams."""
