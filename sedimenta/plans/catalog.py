"""All registered queries, each with its SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.plans import java, tables

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return tables.QUERIES | java.QUERIES


def oracle_sql() -> dict[str, str]:
    return tables.SQL | java.SQL
