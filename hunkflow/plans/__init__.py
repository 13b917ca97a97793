"""Registered queries: name -> (query, equivalent SQL or None)."""

from . import history, relational, scan, toolkit

_MODULES = (scan, relational, toolkit, history)


def all_queries() -> dict:
    return {name: (query, m.ORACLE_SQL.get(name)) for m in _MODULES for name, query in m.QUERIES.items()}
