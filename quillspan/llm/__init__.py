"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to a DataFrame; the registered queries are in :mod:`.queries`.
"""
