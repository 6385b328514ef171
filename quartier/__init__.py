"""Spark-native analytics for priced listings and other mixed tables."""
