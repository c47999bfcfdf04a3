"""Meridian: point-in-time analytics as DataFrame operators for Spark.

Operators are plain functions ``DataFrame -> DataFrame``; nothing is evaluated
until the caller asks for it, except where a docstring says that a stage is
written to the checkpoint folder.
"""

__version__ = "0.1.0"
