"""Operators for training-data pipelines over ``documents``-like tables.

One module per operator; ``queries`` holds the thin registered queries. Nothing
outside this package (but the guard in ``__spark_entry__``) imports it.
"""
