"""Spark-native replay of versioned key-value logs, control-plane views and telemetry analytics."""
