"""Registration of queries next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    """The queries of a module and their DuckDB counterparts."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            self.functions[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return register

    def queries(self) -> dict[str, Callable]:
        return self.functions
