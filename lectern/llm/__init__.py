"""Operators of a large training-data pipeline, each beside its query.

Nothing else in the library imports this subpackage.
"""
