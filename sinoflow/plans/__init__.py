"""Plans of the tomographic engine."""
