"""Aggregates over a ledger of calls: call_type, input_tokens, output_tokens, cached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as X


def with_cost(events: DataFrame, in_price: float = 3.0, out_price: float = 15.0) -> DataFrame:
    cost = X.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached"), in_price, out_price)
    return events.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("cost_usd", cost)


def summary(events: DataFrame) -> DataFrame:
    """One row over all calls. What caching saved is the average of live calls for each hit, rounded down. live_calls leaves
    out those answered without a service, which api_calls counts."""
    e = with_cost(events)
    live = ~F.col("cached")
    total = lambda c: F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0))
    hits = F.count_if(F.col("cached"))
    return e.agg(
        F.count_if(live).alias("api_calls"),
        F.count_if(live & (F.col("call_type") != "heuristic")).alias("live_calls"),
        hits.alias("cache_hits"),
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
        total("total_tokens").alias("total_tokens"),
        F.coalesce((F.avg(F.when(live, F.col("total_tokens"))) * hits).cast("bigint"), F.lit(0)).alias("est_tokens_saved_by_cache"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
        (100.0 * hits / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"),
        (total("input_tokens") / F.greatest(F.count_if(live), F.lit(1))).alias("avg_input"),
    )


def by_type(events: DataFrame) -> DataFrame:
    return with_cost(events).groupBy("call_type").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input"),
        F.sum("output_tokens").alias("output"),
        F.count_if(F.col("cached")).alias("cached"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def newest_first(events: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    out = events.orderBy(F.desc(order))
    return out if limit is None else out.limit(limit)
