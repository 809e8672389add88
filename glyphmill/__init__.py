"""Spark-native analysis and normalisation of large text collections."""
