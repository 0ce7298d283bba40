"""Operators for training-data pipelines, one module per operator.

Nothing else in the library imports this subpackage; ``__spark_entry__``
registers its queries only when it can be imported. ``queries`` binds the
operators to the driver's tables.
"""
