"""Operators for training-data pipelines."""
