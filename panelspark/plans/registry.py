"""Queries of the panel engine and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.plans import context, evaluation, learning, panel, selection, serving

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (panel, context, evaluation, selection, serving, learning):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
