"""Spark-native engine for append-only, hash-chained evidence ledgers."""
