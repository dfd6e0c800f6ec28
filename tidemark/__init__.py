"""Spark-native analytics over panels of daily market bars."""
