"""Lontar: a Spark-first engine for building, cleaning and measuring web-text corpora."""
