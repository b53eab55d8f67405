"""Connected components of a graph that no machine holds: alternating large and small stars over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import column, discard, joined_batches, materialize

#: A node with more edges than this share of all is hot; there are at most twice its inverse, so they can be broadcast.
HOT_SHARE = 0.002


class Union:
    """Union-find over positions 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


#: Edges of which one task makes stars at once: some tens of MB. The number of tasks follows from it, so small graphs take few.
EDGES_PER_TASK = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars around the smallest node of each of its components: never more edges, often fewer."""
    for batch in joined_batches(batches, 2 * EDGES_PER_TASK):
        a, b = (np.asarray(column(batch, x)) for x in ("a", "b"))
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        u = Union(len(nodes))
        for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
            u.join(x, y)
        roots = u.roots()
        other = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[roots[other]])], ["a", "b"])


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    return materialize(edges.coalesce(tasks).mapInArrow(_contract, "a bigint, b bigint"), "contracted")


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Large: every larger neighbour of a node is tied to the smallest of node and neighbours. Small: the same for the smaller
    neighbours and the node itself. Minima are aggregated before they are joined back; hot nodes join by broadcast."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    low = materialize(low.coalesce(tasks), "star")
    least = HOT_SHARE * max(low.agg(F.sum("n")).first()[0] or 0, 500)
    hot = low.where(F.col("n") > least).select("u", "m")
    marked = both.join(F.broadcast(hot.withColumnRenamed("m", "hot")), "u", "left")
    rest = marked.where("hot is null").drop("hot").join(low.where(F.col("n") <= least).select("u", "m"), "u")
    tied = marked.where("hot is not null").select("u", "v", F.col("hot").alias("m")).unionByName(rest)
    if large:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return materialize(out.where("a <> b").distinct().coalesce(tasks), "stars")


def components(edges: DataFrame, most: int = 60, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """node and component, the smallest node it is connected with, for every node of edges (a, b). Each task first makes stars
    of the edges it has; where there is one task only, that is the result. Else stars alternate until nothing changes."""
    every = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    raw = materialize(every, "edges")
    tasks = raw.count() // edges_per_task + 1
    now, seen = _contracted(raw, tasks), None
    for _ in range(most if tasks > 1 else 0):
        spread = _star(now, True, tasks)
        after = _star(spread, False, tasks)
        discard(now), discard(spread)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    roots = now.select("b").distinct().coalesce(tasks).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
