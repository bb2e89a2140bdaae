"""Names of queries and their SQL, which the modules beside this one add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "WIN2_replay"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the name of its operator, with the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add
