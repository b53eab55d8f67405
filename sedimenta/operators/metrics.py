"""Aggregates over classes and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import text as X

CC = "cyclomatic_complexity"


def totals(classes: DataFrame) -> DataFrame:
    """One row: files among the parsed classes, types by kind, methods, lines (one count a file, the last wins), endpoints."""
    lines = classes.groupBy("file_path").agg(F.max_by("loc", "class_ord").alias("loc")).agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("lines_of_code"))
    kinds = classes.agg(
        *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("class", "classes"), ("interface", "interfaces"), ("enum", "enums"))),
        F.coalesce(F.sum(F.size("methods")), F.lit(0)).alias("methods"),
        F.coalesce(F.sum(F.size(F.filter("methods", lambda m: m["http_method"].isNotNull()))), F.lit(0)).alias("rest_endpoints"),
    )
    return lines.crossJoin(kinds)  # one row by one row


def role_counts(classes: DataFrame, *order: str) -> DataFrame:
    """n by role, largest first, ties by first appearance."""
    first = F.min(F.struct(*(order or ("file_path", "class_ord"))))
    return classes.groupBy("role").agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").drop("first")


def module_stats(classes: DataFrame) -> DataFrame:
    """classes, methods and lines by module; a file's lines count once in each run of one module."""
    w = Window.partitionBy("file_path").orderBy("class_ord")
    new = F.coalesce(F.lag("module").over(w) != F.col("module"), F.lit(True))
    marked = classes.select("module", F.size("methods").alias("m"), F.when(new, F.col("loc")).otherwise(0).alias("own"))
    return marked.groupBy("module").agg(F.count("*").alias("classes"), F.sum("m").alias("methods"), F.sum("own").alias("loc")).orderBy("module")


def complexity_summary(methods: DataFrame, cc: Column | str = CC) -> DataFrame:
    """One row: average, most, methods over 10, and the three bands. Without methods one method of complexity 0 counts."""
    c = F.col(cc) if isinstance(cc, str) else cc
    n = F.count(c)
    one = lambda e, empty: F.when(n == 0, empty).otherwise(e)
    return methods.agg(
        one(F.round(F.avg(c), 2), 0.0).alias("average"),
        one(F.max(c), 0).alias("max"),
        F.count_if(c > 10).alias("methods_over_10"),
        one(F.count_if(c <= 4), 1).alias("simple_1_4"),
        F.count_if((c >= 5) & (c <= 10)).alias("moderate_5_10"),
        F.count_if(c > 10).alias("complex_over_10"),
    )


def hotspots(methods: DataFrame, cc: str = CC, order: tuple[str, ...] = ("file_path", "class_ord", "method_ord"), least: int = 5, limit: int = 15) -> DataFrame:
    """The most complex methods, ties in source order."""
    return methods.where(F.col(cc) >= least).orderBy(F.desc(cc), *order).limit(limit)


def endpoints(methods: DataFrame) -> DataFrame:
    """Verb, path, controller and handler of every endpoint, by controller and path."""
    rows = methods.where("http_method is not null")
    path = X.endpoint_path(F.col("base_path"), F.col("http_path"))
    return rows.select("http_method", path.alias("path"), F.col("class_name").alias("controller"), F.col("name").alias("handler"), "file_path", "class_ord", "method_ord").orderBy("controller", "path", "file_path", "class_ord", "method_ord").drop("file_path", "class_ord", "method_ord")
