"""Operators for training-data pipelines over whole document tables."""
