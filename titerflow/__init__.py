"""Assay and response analytics as Spark DataFrame operators.

Data is long: one row per ``(entity, target, value)``.  See README.md for the operator list.
"""
__version__ = "0.1.0"
