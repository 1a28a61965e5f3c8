"""How plan modules register queries."""

from __future__ import annotations


class Registry:
    """Queries by name, with the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add
