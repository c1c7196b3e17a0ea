"""Spark-native processing of web-frontier tables and text corpora."""
