"""Spatial single-cell analytics as lazy PySpark DataFrame transformations."""
