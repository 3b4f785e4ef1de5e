"""Spark-native analytics over article corpora and news knowledge graphs."""
