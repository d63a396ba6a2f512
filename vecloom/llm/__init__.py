"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this package.  ``registry`` lists the
queries and their SQL; every other module holds one operator with its own
general interface.
"""
