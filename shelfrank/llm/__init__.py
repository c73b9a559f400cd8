"""Operators for preparing training data, and their registered queries.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
