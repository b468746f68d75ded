"""Operators for training-data pipelines over large document tables.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` registers the thin
``opN_<name>`` queries and their SQL.
"""
