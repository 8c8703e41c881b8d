"""Spark-native analytics of document-job metadata."""
