"""Queries by name, each with the DuckDB statement it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.found: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None) -> Callable[[Query], Query]:
        """Register a query under its function's name, with its SQL if there is one."""

        def add(f: Query) -> Query:
            self.found[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
