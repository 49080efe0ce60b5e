"""Functions of the tomographic engine."""
