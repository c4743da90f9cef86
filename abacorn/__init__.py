"""Spark-native double-entry ledger analytics."""
