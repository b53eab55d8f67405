"""Exact length histogram: documents by encoded length, and what its suffix sums answer for every context limit.

A null or empty text has length 0; texts of any length are encoded whole. Repeated rows count as often as they occur.
Columns besides text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.bpe import TEXT_BYTES, at_work, default_tokenizer_path
from sedimenta.llm.common import column, materialize, small_batches

#: Lengths that share a block of the two-level suffix sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length. Workers count before anything is shuffled."""
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        with at_work(path) as c:
            for batch in small_batches(batches, limit=TEXT_BYTES):
                counts.update(len(x) // 4 for x in c.encode_batch([x or "" for x in column(batch, "text").to_pylist()]))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["n_tokens", "n"])

    return docs.select("text").mapInArrow(run, "n_tokens bigint, n bigint").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length: documents and tokens at least as long, and the total if every text were cut to that length.

    Two levels, so that no task holds more than a block of lengths or one row for each block. The histogram, which is read
    several times, is stored first, so that texts are encoded once.
    """
    histogram = materialize(histogram, "lengths")
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(f"b_{x}").over(after), F.lit(0)).alias(f"after_{x}") for x in ("docs", "tokens")),
        *(F.sum(f"b_{x}").over(every).alias(f"all_{x}") for x in ("docs", "tokens")),
    )
    own = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    longer = h.select("*", F.sum("n_docs").over(own).alias("own_docs"), F.sum("tokens").over(own).alias("own_tokens")).join(blocks, "block")
    docs, tokens = F.col("own_docs") + F.col("after_docs"), F.col("own_tokens") + F.col("after_tokens")
    return longer.select(
        "n_tokens",
        "n_docs",
        "tokens",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_total"),
        ((F.col("all_docs") - docs + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row, total: the tokens left if every document is cut to limit, also where no document has that length."""
    longer = F.when(F.col("n_tokens") > limit, F.col("n_docs"))
    shorter = F.when(F.col("n_tokens") <= limit, F.col("tokens"))
    return sums.agg((F.coalesce(F.sum(shorter), F.lit(0)) + limit * F.coalesce(F.sum(longer), F.lit(0))).alias("total"))


def length_quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the smallest length that at least a share q of the documents does not exceed; null if there are none."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
