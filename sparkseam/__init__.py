"""Spark-native retrieval, rule evaluation and corpus analytics."""
