"""Training-data operators: one module for each, and ``registry`` with their queries and SQL.

Nothing else in the library imports this subpackage.
"""
