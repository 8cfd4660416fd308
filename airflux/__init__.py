"""Spark-native analytics for trace-gas observations and surface-flux estimation."""
