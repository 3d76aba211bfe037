"""Every query of the core with its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import domain, orphan_queries, relational, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (relational, domain, views, orphan_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
FLAGSHIP = "stratified_sample_join_back"
