"""Spark-native record linkage, screening and bibliography engine."""
