"""Operators of a training-data pipeline over `documents` and `pages`.

Nothing else in the library imports this subpackage.  Each operator is a
function over DataFrames with its own interface; ``queries.py`` holds the thin
registered queries and their DuckDB SQL.
"""
