"""Operators for training-data pipelines over text. Nothing outside this package imports it."""
