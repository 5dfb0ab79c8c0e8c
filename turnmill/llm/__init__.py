"""Corpus operators for large text collections.

Nothing else in the package imports this subpackage; ``queries`` holds its
registered queries and ``oracles`` their SQL.
"""
