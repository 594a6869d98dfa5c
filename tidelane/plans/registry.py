"""Keeps a module's queries and their oracle SQL together."""

from __future__ import annotations


def registry():
    """(QUERIES, SQL, decorator): @query(sql) registers a function under its name, with or without SQL."""
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return keep

    return queries, sql, query
