"""Spark-native analysis and condensing of long ordered message logs."""
