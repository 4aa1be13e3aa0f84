"""Operators for training-data pipelines over the tables of texts, vectors and pages."""
