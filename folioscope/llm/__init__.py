"""Operators for training-data pipelines over text and vectors, one module each."""
