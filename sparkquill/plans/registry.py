"""All registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkquill.plans import analytics_queries, report_queries, search_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = search_queries.QUERIES | analytics_queries.QUERIES | report_queries.QUERIES
ORACLES: dict[str, str] = search_queries.ORACLES | analytics_queries.ORACLES | report_queries.ORACLES
