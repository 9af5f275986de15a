"""Named queries over the derived views, with equivalent SQL for the checking engine where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name."""
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def load() -> None:
    """Import every module that registers queries."""
    from wiretide.registry import alerts, domains, flows, learning, payloads, windows  # noqa: F401
