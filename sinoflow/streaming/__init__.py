"""Streaming of the tomographic engine."""
