"""Where the families register their queries."""

from __future__ import annotations

from fragx.fixtures import with_fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, tables: dict[str, str] | None = None):
    """Decorator: the query under ``name``; ``sql`` may use fixtures and the named extra ``tables``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, tables)
        return fn

    return add
