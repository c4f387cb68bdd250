"""All site-analysis queries and their SQL, collected from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.plans import access, assets, content, crawl, dashboard, documents, findings, graph, guards, rating, views  # noqa: F401  (they enter their queries)
from webstrata.plans.catalog import CATALOG

FLAGSHIP = "consistency_report"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
