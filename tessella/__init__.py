"""Spark-first analytics over question banks, label models and learning logs."""
