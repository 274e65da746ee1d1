"""Operators for large-scale training-data preparation; nothing outside this folder imports it."""
