"""Where plans enter themselves: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def enter(f: Query) -> Query:
        CATALOG[name] = (f, sql)
        return f

    return enter
