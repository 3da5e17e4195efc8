"""Folioforge: Spark-native document-synthesis analytics."""
