"""Listing match and margin analytics, written as Spark DataFrame plans."""
