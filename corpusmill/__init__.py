"""Spark-first operators for building and analysing text corpora."""
