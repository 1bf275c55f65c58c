"""Operators for large training-data pipelines. Nothing else in this library imports them."""
