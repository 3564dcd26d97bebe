"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage. ``queries`` holds the registered queries and their SQL.
"""
