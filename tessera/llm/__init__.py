"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` wires them to the tables.
"""
