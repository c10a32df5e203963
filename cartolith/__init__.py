"""Codebase architecture analytics as PySpark DataFrames."""
