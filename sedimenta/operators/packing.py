"""Text cards of classes, and their packing into chunks of bounded tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sedimenta.functions import text as X


def digest(file: Column, kind: Column, name: Column, role: Column, **optional: Column) -> Column:
    """The card of a class: one line for each part that isn't empty."""
    o = optional
    some = lambda c, e: F.when(c.isNotNull() & (c != ""), e)
    many = lambda c, e: F.when(F.size(c) > 0, e)
    method = lambda m: F.concat(
        F.lit("  - "),
        m["signature"],
        F.when(m["http_method"].isNotNull(), F.concat(F.lit(" ["), m["http_method"], F.lit(" "), F.coalesce(m["http_path"], F.lit("")), F.lit("]"))).otherwise(""),
        F.lit(" (cc="),
        m["cyclomatic_complexity"].cast("string"),
        F.lit(")"),
        F.when(F.coalesce(m["javadoc"], F.lit("")) != "", F.concat(F.lit("\n      doc: "), F.left(m["javadoc"], F.lit(120)))).otherwise(""),
    )
    parts = [F.concat(F.lit("FILE: "), file), F.concat(F.upper(kind), F.lit(": "), name, F.lit("  [role="), role, F.lit("]"))]
    if "annotations" in o:
        parts.append(many(o["annotations"], F.concat(F.lit("  annotations: "), F.array_join(F.transform(o["annotations"], lambda a: F.concat(F.lit("@"), a)), ", "))))
    if "extends" in o:
        parts.append(some(o["extends"], F.concat(F.lit("  extends: "), o["extends"])))
    if "implements" in o:
        parts.append(many(o["implements"], F.concat(F.lit("  implements: "), F.array_join(o["implements"], ", "))))
    if "base_path" in o:
        parts.append(some(o["base_path"], F.concat(F.lit("  base path: "), o["base_path"])))
    if "dependencies" in o:
        parts.append(many(o["dependencies"], F.concat(F.lit("  injected deps: "), F.array_join(F.array_sort(F.array_distinct(o["dependencies"])), ", "))))
    if "javadoc" in o:
        parts.append(some(o["javadoc"], F.concat(F.lit("  javadoc: "), F.left(o["javadoc"], F.lit(200)))))
    if "methods" in o:
        parts.append(many(o["methods"], F.array_join(F.transform(o["methods"], method), "\n")))
    return F.concat_ws("\n", *parts)


def class_digests(classes: DataFrame) -> DataFrame:
    names = ("annotations", "extends", "implements", "base_path", "dependencies", "javadoc", "methods")
    card = digest(F.col("file_path"), F.col("kind"), F.col("qualified_name"), F.col("role"), **{n: F.col(n) for n in names})
    return classes.select("module", "file_path", "class_ord", card.alias("digest"))


def pack_bins(tokens: Column, budget: int) -> Column:
    """Number of the bin of each item of an array of tokens, from 0: the next bin starts where an item would overfill one that
    isn't empty; an item over the budget weighs as much as the budget. The fold copies what it has at each step: it is for
    short arrays, item_bins() for tables."""
    weight = lambda t: F.least(t, F.lit(budget))
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).alias("held"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("bins"))

    def step(s: Column, t: Column) -> Column:
        full = (s["n"] > 0) & (s["held"] + weight(t) > budget)
        bin_ = F.when(full, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(bin_.alias("bin"), F.when(full, weight(t)).otherwise(s["held"] + weight(t)).alias("held"), F.lit(1).alias("n"), F.concat(s["bins"], F.array(bin_)).alias("bins"))

    return F.aggregate(tokens, start, step, lambda s: s["bins"])


def item_bins(items: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """items (module, order columns, tokens) with chunk, the number of their bin, as pack_bins() tells it. A module's items
    stream sorted through one task, whose memory is that of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, chunk, held, n, first = None, 0, 0, 0, True
        for batch in batches:
            bins = []
            for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first or m != module:
                    module, chunk, held, n, first = m, 0, 0, 0, False
                t = min(t or 0, budget)
                if n and held + t > budget:
                    chunk, held, n = chunk + 1, 0, 0
                held, n = held + t, n + 1
                bins.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int32())], [*batch.schema.names, "chunk"])

    names = ["module", "tokens", *(c for c in items.columns if c not in ("module", "tokens"))]
    ordered = items.repartition("module").sortWithinPartitions("module", *order).select(names)
    schema = StructType([*ordered.schema.fields, StructField("chunk", IntegerType())])
    return ordered.mapInArrow(run, schema)


CHUNK = "module string, chunk int, items bigint, tokens bigint, text string"


def pack(items: DataFrame, budget: int, order: list[str], chars_per_token: float = X.CHARS_PER_TOKEN) -> DataFrame:
    """Chunks of items (module, order columns, digest): next fit in order, never over a module's end.

    Bins depend on all items before, so a module is one sequence. Its items stream sorted through one task that holds a chunk
    and no more; the fold of pack_bins() gives the same for modules that fit into an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, chunk, held, texts = None, 0, 0, []
        out: list[tuple] = []

        def close() -> None:
            if texts:
                out.append((module, chunk, len(texts), held, "\n\n".join(texts)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in CHUNK.split(", ")])

        first = True
        for batch in batches:
            for m, digest_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if first or m != module:
                    close()
                    module, chunk, held, texts, first = m, 0, 0, [], False
                t = int(len(digest_) / chars_per_token) + 1
                if t > budget:
                    digest_, t = digest_[: int(budget * chars_per_token)], budget
                if texts and held + t > budget:
                    close()
                    chunk, held, texts = chunk + 1, 0, []
                texts.append(digest_)
                held += t
            if out:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    ordered = items.where("digest is not null").repartition("module").sortWithinPartitions("module", *order)
    return ordered.select("module", "digest").mapInArrow(run, CHUNK)


def split_items(items: DataFrame, order: list[str]) -> DataFrame:
    """items with half, 0 or 1: the first half of each chunk's blocks, rounded down, and the rest; one block stays whole."""
    from pyspark.sql import Window

    w = Window.partitionBy("module", "chunk")
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    return items.withColumn("half", F.when(n <= 1, 0).when(at <= F.floor(n / 2), 0).otherwise(1))
