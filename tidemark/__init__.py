"""Spark-first analytics on market bars."""
