"""Tomographic analytics on Spark."""
