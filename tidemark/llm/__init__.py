"""Operators for large-scale training data, each with a general function and a registered query."""
