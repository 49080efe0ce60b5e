"""Sources of the tomographic engine."""
