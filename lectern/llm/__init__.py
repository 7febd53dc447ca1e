"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; each module holds one
operator and ``queries`` registers the thin digest queries over them.
"""
