"""Spark-native analytics over redundant data: find, group, explain and plan."""
