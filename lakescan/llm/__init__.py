"""Operators for preparing training text: tokenising, deduplication, filtering and mixing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries.py`` applies each to its whole table.
"""
