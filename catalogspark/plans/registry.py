"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import queries_catalog, queries_jobs, queries_metrics, queries_pages, queries_streams  # noqa: F401
