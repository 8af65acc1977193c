"""Spark-native normalisation of nested JSON into typed relational tables."""
