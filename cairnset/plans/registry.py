"""Registers queries under their function's name, with the SQL they are compared with (none: rows only)."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
