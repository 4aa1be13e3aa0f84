"""Standardise study-style source tables, derive analysis tables and check them, on Spark."""
