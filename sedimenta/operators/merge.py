"""Keyed merges, deduplication by order, and the cache of computed chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import text as X
from sedimenta.workers import stored


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order. An aggregate, so rows are combined before they are shuffled."""
    rest = F.struct(*(c for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.max_by(rest, order).alias("r")).select(*keys, "r.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the least order."""
    rest = F.struct(*(c for c in df.columns if c not in keys))
    return df.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("r")).select(*keys, "r.*")


def carry_forward(df: DataFrame, column: str, partition: list[str], order: list[str], name: str) -> DataFrame:
    """The last value before each row that isn't null."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def spans_to_next(df: DataFrame, start: str, partition: list[str], end: Column | str, name: str = "end") -> DataFrame:
    """Where each row's span ends: at the next start, else at end."""
    w = Window.partitionBy(*partition).orderBy(start)
    return df.withColumn(name, F.coalesce(F.lead(start).over(w), F.col(end) if isinstance(end, str) else end))


def with_key(chunks: DataFrame, *parts: str) -> DataFrame:
    return chunks.withColumn("cache_key", X.cache_key(*map(F.col, parts)))


def cache_split(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with a cache_key that the cache has, with its payload, and those that it hasn't."""
    keys = last_wins(cache.select("cache_key", "payload", "ord"), ["cache_key"], "ord").select("cache_key", "payload") if "ord" in cache.columns else cache.select("cache_key", "payload").dropDuplicates(["cache_key"])
    return chunks.join(keys, "cache_key"), chunks.join(keys, "cache_key", "left_anti")


def cached_map(chunks: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """payload and status (cached or computed) of each chunk: extract() sees what the cache hasn't, once, and adds payload."""
    hits, misses = cache_split(chunks, cache)
    return hits.withColumn("status", F.lit("cached")).unionByName(stored(extract(misses)).withColumn("status", F.lit("computed")))


def retry_failed(items: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], fallback: Callable[[DataFrame], DataFrame], depth: int = 2) -> DataFrame:
    """Rows of attempt(items, level), which adds ok; failed ones are tried again up to depth times, what still fails gets
    fallback. A fixed number of passes over what failed, no loop over rows. Each pass is stored, so attempt() sees a row once a
    level, however often the result is read. lifecycle.map_chunks() is the same with splitting."""
    done, rest = None, items
    columns = items.columns
    for level in range(depth + 1):
        tried = stored(attempt(rest, level))
        good = tried.where("ok").drop("ok").withColumn("status", F.lit("computed"))
        done = good if done is None else done.unionByName(good)
        rest = tried.where("not ok").select(columns)
    return done.unionByName(fallback(rest).withColumn("status", F.lit("fallback")))


def merge_insights(classes: DataFrame, insights: DataFrame, key: str = "qualified_name", order: str = "ord") -> DataFrame:
    """classes with the summary of the last insight about each, or their own comment where there is none."""
    last = last_wins(insights.select(key, "summary", order), [key], order).withColumnRenamed("summary", "__summary").drop(order)
    return classes.join(last, key, "left").withColumn("summary", F.coalesce(X.blank_to_null(F.col("__summary")), F.col("javadoc"))).drop("__summary")


def merge_methods(methods: DataFrame, notes: DataFrame, order: str = "ord") -> DataFrame:
    """methods with the last description for their class and name; overloads share it."""
    last = last_wins(notes.select("qualified_name", "name", "description", order), ["qualified_name", "name"], order).withColumnRenamed("description", "__note").drop(order)
    return methods.join(last, ["qualified_name", "name"], "left").withColumn("description", F.coalesce(X.blank_to_null(F.col("__note")), F.col("javadoc"))).drop("__note")


def replay(rows: DataFrame, notes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column overwritten where notes (key, value) have one that isn't empty."""
    return rows.join(notes.select(key, F.col("value").alias("__value")), key, "left").withColumn(column, F.coalesce(X.blank_to_null(F.col("__value")), F.col(column))).drop("__value")


def heuristic_insights(classes: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries of classes and descriptions of methods from names alone."""
    summary = F.concat(F.lit("Member of module "), F.col("module"), F.lit("; responsibility inferred from its name and annotations."))
    notes = methods.select("qualified_name", "name", X.describe_method(F.col("name"), F.col("signature")).alias("description"), (F.col("class_ord") * 100_000 + F.col("method_ord")).alias("ord"))
    return classes.select("qualified_name", summary.alias("summary"), F.col("class_ord").alias("ord")), notes


def fold_observations(observations: DataFrame, order: list[str]) -> DataFrame:
    """One row, text: observations (module, observation) in order, each line with its module in brackets."""
    line = F.concat(F.lit("["), F.col("module"), F.lit("] "), F.col("observation"))
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return observations.agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
