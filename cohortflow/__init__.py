"""Spark-native analytics for longitudinal, per-entity event data."""
