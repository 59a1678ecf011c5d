"""How a module declares queries: a DataFrame function and, where there is one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    """Collects the queries of one module."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            self.functions[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register
