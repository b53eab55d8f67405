"""Calls of a language model over chunks: cache, split and retry, fallback, warnings, and the overview made of all.

A call is a function that the caller passes: of rows with a text it gives the same rows with classes (an array of structs),
observations (an array of strings) and error, null where it succeeded. What it gives is stored before anything is made of
it, so no row is sent twice however often the result is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as X
from sedimenta.operators import merge, packing
from sedimenta.workers import stored

Call = Callable[[DataFrame], DataFrame]

#: Parts of a message that tell of an answer that was cut off, in lower case; fixed values.
CUT_OFF = ("max_tokens", "returned none", "schema not satisfied", "truncated")

#: How often a chunk is split, and characters of an error that a warning carries.
DEPTH, SHOWN = 2, 120

#: Share of a chunk's tokens that an answer is taken to need.
ANSWER_SHARE = 0.6

BLOCK = "\n\n"


def is_cut_off(error: Column) -> Column:
    low = F.lower(error)
    out = F.lit(False)
    for mark in CUT_OFF:
        out = out | F.contains(low, F.lit(mark))
    return out


def halves(rows: DataFrame, key: list[str], budget: int, chars_per_token: float = X.CHARS_PER_TOKEN) -> DataFrame:
    """rows (key, part, text) split: the first half of each text's blocks, rounded down, and the rest, each packed anew under
    half of the budget; part, an array, goes on with the half and the chunk in it."""
    held = rows.select(F.struct(*key).alias("key"), "part", F.split("text", BLOCK).alias("blocks"))
    items = held.select("key", "part", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    items = items.withColumn("half", F.when(F.col("pos") < F.floor(F.col("n") / 2), 0).otherwise(1))
    items = items.withColumn("module", F.to_json(F.struct("key", "part", "half"))).withColumn("tokens", X.estimate_tokens(F.col("block"), chars_per_token))
    binned = packing.item_bins(items, max(budget // 2, 1), ["pos"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), BLOCK)
    out = binned.groupBy("key", "part", "half", "chunk").agg(text.alias("text"))
    return out.select("key.*", F.concat("part", F.array("half", "chunk")).alias("part"), "text")


@dataclass
class Mapped:
    """chunks: key, classes, observations, status (cached, computed, split or fallback) and error; fresh: what the cache should
    be given; warnings: key and message."""

    chunks: DataFrame
    fresh: DataFrame
    warnings: DataFrame


def map_chunks(chunks: DataFrame, key: list[str], call: Call, heuristic: Call, cache: DataFrame | None = None, budget: int = 8000, depth: int = DEPTH, model: str = "") -> Mapped:
    """Insights of chunks (key, text). What the cache (cache_key, classes, observations) has isn't sent. A chunk whose answer
    was cut off is split, at most depth times, and its parts' lists are joined in order; one block that can't be split gets
    the heuristic. Any other error, or one at the last depth, gives the whole chunk to the heuristic, with a warning."""
    keyed = chunks.withColumn("cache_key", X.cache_key(F.lit("map"), F.lit(model), F.col("text")))
    rest = stored(keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti"))
    columns = [*key, "part", "classes", "observations"]
    pending, good, bad = rest.select(*key, F.array().cast("array<int>").alias("part"), "text"), [], []
    for level in range(depth + 1):
        tried = stored(call(pending))
        good.append(tried.where("error is null").select(columns))
        failed = tried.where("error is not null")
        cut = is_cut_off(F.col("error")) if level < depth else F.lit(False)
        one = F.size(F.split("text", BLOCK)) < 2
        good.append(heuristic(failed.where(cut & one).select(*key, "part", "text")).select(columns))
        bad.append(failed.where(~cut).select(*key, "error"))
        pending = stored(halves(failed.where(cut & ~one), key, budget))
        if not pending.take(1):
            break
    errors = stored(_union(bad).groupBy(*key).agg(F.min("error").alias("error")))
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", F.col(c).alias("x"))), lambda a, b: F.when(a["part"] < b["part"], -1).when(a["part"] > b["part"], 1).otherwise(0)), lambda x: x["x"])).alias(c)
    parts = _union(good).join(errors, key, "left_anti").groupBy(*key).agg(listed("classes"), listed("observations"), F.count("*").alias("parts"))
    done = parts.select(*key, "classes", "observations", F.when(F.col("parts") > 1, "split").otherwise("computed").alias("status"), F.lit(None).cast("string").alias("error"))
    lost = rest.join(errors, key)
    told = heuristic(lost.select(*key, F.array().cast("array<int>").alias("part"), "text")).select(*key, "classes", "observations").join(errors, key).select(*key, "classes", "observations", F.lit("fallback").alias("status"), "error")
    every = done.unionByName(told)
    if cache is not None:
        hits = keyed.join(cache.select("cache_key", "classes", "observations").dropDuplicates(["cache_key"]), "cache_key")
        every = every.unionByName(hits.select(*key, "classes", "observations", F.lit("cached").alias("status"), F.lit(None).cast("string").alias("error")))
    message = F.concat(F.lit("The model failed on a chunk; told from names instead. Reason: "), F.left("error", F.lit(SHOWN)))
    return Mapped(every, done.join(rest.select(*key, "cache_key"), key).select("cache_key", "classes", "observations"), errors.select(*key, message.alias("message")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def budget_warning(chunks: DataFrame, max_output_tokens: int) -> DataFrame:
    """One row, message, null where the answer to the largest chunk (tokens) is likely to fit."""
    most = chunks.agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("most"))
    need = F.floor(F.col("most") * ANSWER_SHARE)
    text = F.concat(F.lit(f"answers of {max_output_tokens} tokens may be too short for chunks of "), F.col("most"), F.lit(" tokens; "), need, F.lit(" are advised. Chunks are split where they are cut off."))
    return most.select(F.when(need > max_output_tokens, text).alias("message"))


def overview_input(context: DataFrame, observations: DataFrame, metrics: DataFrame, order: list[str]) -> DataFrame:
    """One row, text: context files (name, text, ord), figures (metrics, one row), and observations (module, observation) in
    order, of which an overview is made."""
    part = F.concat(F.lit("=== "), F.col("name"), F.lit(" ===\n"), F.col("text"))
    files = context.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), BLOCK).alias("files"))
    seen = merge.fold_observations(observations, order).select(F.col("text").alias("seen"))
    row = files.crossJoin(metrics.select("metrics")).crossJoin(seen)  # rows of one
    return row.select(F.concat("files", F.lit("\n\n=== Figures ===\n"), "metrics", F.lit("\n\n=== Observations ===\n"), "seen").alias("text"))


def reduce_overview(text: DataFrame, call: Call, empty: dict[str, str], cache: DataFrame | None = None, model: str = "") -> DataFrame:
    """One row: overview (a map), status (cached, computed or empty), cache_key and warning. call() gives overview and error of
    a row with text; an error gives the empty overview and a warning. cache: cache_key, overview."""
    row = text.withColumn("cache_key", X.cache_key(F.lit("reduce"), F.lit(model), F.col("text")))
    none = F.create_map(*(F.lit(x) for p in empty.items() for x in p))
    if cache is not None:
        row = stored(row.join(cache.select("cache_key", F.col("overview").alias("kept")).dropDuplicates(["cache_key"]), "cache_key", "left"))
        hits = row.where("kept is not null").select(F.col("kept").alias("overview"), F.lit("cached").alias("status"), "cache_key", F.lit(None).cast("string").alias("warning"))
        row = row.where("kept is null").drop("kept")
    tried = stored(call(row))
    ok = F.col("error").isNull()
    warning = F.concat(F.lit("No overview was made: "), F.left("error", F.lit(2 * SHOWN)))
    out = tried.select(F.when(ok, F.col("overview")).otherwise(none).alias("overview"), F.when(ok, "computed").otherwise("empty").alias("status"), "cache_key", F.when(~ok, warning).alias("warning"))
    return out if cache is None else hits.unionByName(out)


def strategy(key: str | None, call: Call, heuristic: Call, placeholders: tuple[str, ...] = ("your-key-here", "")) -> Call:
    """The call where there is a key that isn't a placeholder, else the heuristic."""
    return heuristic if (key or "").strip() in placeholders else call
