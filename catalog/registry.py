"""Named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from catalog.fixtures import Tables, sql as with_tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROWS: dict[str, str] = {}


def query(name: str, row: str, oracle: str | None = None, **ctes: str):
    """Register a query for inventory row(s) `row`, with its SQL twin where there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name], ROWS[name] = fn, row
        if oracle is not None:
            ORACLE[name] = with_tables(oracle, **ctes)
        return fn

    return add
