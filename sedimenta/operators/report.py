"""Filters and projections of reports: what is shown of findings, flows, files and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as X

#: Severities shown unless others are asked for.
SHOWN = ("critical", "high", "medium")


def filter_findings(findings: DataFrame, severities: tuple[str, ...] = SHOWN, categories: list[str] | None = None) -> DataFrame:
    out = findings.where(F.col("severity").isin(*severities))
    return out.where(F.col("category").isin(*categories)) if categories else out


def file_rows(files: DataFrame) -> DataFrame:
    """file, path, lines, longest first."""
    return files.select(X.base_name(F.col("path")).alias("file"), "path", F.col("loc").alias("lines")).orderBy(F.desc("lines"), "path")


def hotspot_rows(hotspots: DataFrame) -> DataFrame:
    return hotspots.select(F.col("cyclomatic_complexity").alias("cc"), F.col("qualified_name").alias("class"), F.col("name").alias("method"), X.base_name(F.col("file_path")).alias("file"))


def dependency_rows(unique: DataFrame) -> DataFrame:
    return unique.select(X.title(F.col("kind")).alias("kind"), F.col("sub_type").alias("type"), "direction", "detail", X.base_name(F.col("path")).alias("file"))


def table_rows(tables: DataFrame) -> DataFrame:
    return tables.select("table", "schema", X.base_name(F.col("path")).alias("file")).orderBy("table", "file")


def finding_rows(findings: DataFrame) -> DataFrame:
    """Findings without the columns that only order them."""
    return findings.drop("rule_ord")


def reduce_input(totals: DataFrame, roles: DataFrame, complexity: DataFrame) -> DataFrame:
    """One row, metrics: JSON of the figures that an overview is made from."""
    listed = roles.agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("class_roles"))
    both = totals.select(F.struct("*").alias("totals")).crossJoin(complexity.select(F.struct("*").alias("cyclomatic_complexity"))).crossJoin(listed)  # rows of one
    return both.select(F.to_json(F.struct("totals", "class_roles", "cyclomatic_complexity")).alias("metrics"))


def usage(responses: DataFrame, column: str = "response") -> DataFrame:
    """responses with input_tokens and output_tokens from their JSON, under either of two names; 0 where there are none."""
    first = lambda *paths: F.coalesce(*(F.get_json_object(column, p).cast("bigint") for p in paths), F.lit(0))
    return responses.withColumn("input_tokens", first("$.usage.input_tokens", "$.usage.prompt_tokens")).withColumn("output_tokens", first("$.usage.output_tokens", "$.usage.completion_tokens"))
