"""Spark-native table replication, change tracking and comparison."""
