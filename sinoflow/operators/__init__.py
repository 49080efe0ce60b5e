"""Operators of the tomographic engine."""
