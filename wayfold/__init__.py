"""Spark-first structuring, scoring and reporting of free-text postal addresses."""
