"""Operators for large training-data pipelines. Nothing else in leafmark imports this subpackage."""
