"""Spark-native analytics over gridded forecast data."""
