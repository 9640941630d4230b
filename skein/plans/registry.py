"""How plan modules register a query with its SQL."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if sql:
                oracles[function.__name__] = sql
            return function

        return add

    return queries, oracles, query
