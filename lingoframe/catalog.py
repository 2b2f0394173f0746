"""The queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lingoframe.plans import clausewitz_queries, fluent_queries, gettext_queries, tabular_queries

PARTS = (tabular_queries, clausewitz_queries, fluent_queries, gettext_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for p in PARTS for n, q in p.QUERIES.items()}
ORACLES: dict[str, str] = {n: q for p in PARTS for n, q in p.ORACLES.items()}
