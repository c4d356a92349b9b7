"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    """Collects queries and their DuckDB twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.oracles[key] = sql
            return f

        return add
