"""Registered queries, each with its reference SQL where one exists.

Shared SQL derivations are named common table expressions; `with_ctes` emits the
ones a query needs, in the order they were declared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
_CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    _CTES[name] = body


def _uses(sql: str) -> set[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return {n for n in _CTES if n in words}


def with_ctes(sql: str) -> str:
    need, todo = set(), _uses(sql)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo |= _uses(_CTES[n]) - {n}
    if not need:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in _CTES if n in need)
    return f"WITH {head}\n{sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {head},\n{sql.lstrip()[5:]}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn

    return register
