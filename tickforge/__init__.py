"""Spark-native analytics over order-book, balance, lending and bridge event logs."""
