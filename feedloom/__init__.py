"""Spark-native toolkit for turning raw pages and feeds into clean, scored, de-duplicated content."""
