"""Spark-first analytics over typed architecture graphs."""
