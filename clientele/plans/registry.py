"""Collects the query callables and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}
        self.results: dict[str, Query] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return keep

    def add_rows(self, name: str) -> Callable[[Query], Query]:
        """The rows that SQL can't give, of an operator whose query ``name`` returns facts on them; a query ``{name}_rows``."""
        def keep(fn: Query) -> Query:
            if f"{name}_rows" in self.results:
                raise ValueError(f"rows of {name} registered twice")
            self.results[f"{name}_rows"] = fn
            return fn
        return keep


REG = Registry()
