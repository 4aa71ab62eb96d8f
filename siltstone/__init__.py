"""Spark-native evidence retrieval, reconciliation and governance operators."""
