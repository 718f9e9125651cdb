"""Where the query modules enter what they offer."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return enter
