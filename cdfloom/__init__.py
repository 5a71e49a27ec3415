"""Distributional regression under order constraints, and training-data operators, on Spark."""
