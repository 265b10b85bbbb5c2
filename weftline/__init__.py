"""Spark-native cross-categorization analytics and data preparation."""
