"""Spark-first analytics over labelled record pairs and text corpora."""
