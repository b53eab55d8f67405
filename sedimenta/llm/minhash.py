"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text's set of 5-word shingles becomes a signature. Texts with equal sets are one class, represented once.
2. Every tree of the forest orders the classes by signature values of its own. What stands together shares a prefix. The
   depth is adaptive per region: two classes are candidates if those that share with them all that they share are few; so
   in a sparse region two values are enough, and a dense one is gone into value by value until it is small or the key
   ends. In dense regions each class is a candidate of its neighbours of longest common prefix on both sides, too.
   Candidates are kept if sizes and signatures allow for a similarity of 0.75.
3. Neighbours need not be the right ones where a region is dense because its texts share passages. So classes of dense
   regions also meet by their rarest shingles: two sets with a similarity of 0.75 share one among the rarest quarter of
   each. Shingles of few classes give pairs, filtered as above; those of many tie their classes together.
4. Candidates form coarse clusters. Two classes with a similarity of 0.75 share a region of three values in some tree but
   for a chance of 2e-6; if that region is small, they are a pair, if it is dense, they meet in step 3.
5. Inside clusters links are confirmed on full sets. A small cluster is one group, solved exactly. A large one is cut into
   blocks: each block is solved, and the first against all others; then a class outside the largest component meets the
   blocks that have one of its rarest shingles. So no link between two components stays untested.

A null text or one without words has an empty set: it is linked with nothing and kept. Repeated rows and equal texts are
one class. doc_ids may have any type that has an order; null ones are labelled after all others. Columns besides doc_id
and text pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import column, discard, few, joined_batches, keyed, materialize, small_batches, text_bytes
from sedimenta.llm.components import Union, components
from sedimenta.llm.shingles import shingle_sets, signatures

SHINGLE = 5
PERCENT = 75
TREES = 24
VALUES = 4 * TREES

#: Signature values of a tree's key, the least that candidates share, and those that two classes of 0.75 share in some tree.
DEPTH, SHALLOW, SURE = 6, 2, 3

#: Classes in a region up to which all of them are candidates of each other, and neighbours on each side in a dense one.
SMALL, NEAR = 16, 2

#: Equal signature values that a pair in a small region needs. Of 96 at a similarity of 0.75 fewer agree once in 1e8.
AGREE = 46

#: A cluster with more classes or shingles is solved in blocks of about BLOCK classes.
CLUSTER_CLASSES, CLUSTER_SHINGLES, BLOCK = 512, 1 << 21, 256


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (a digest of the set, null if empty) and sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = shingle_sets(*text_bytes(column(batch, "text")), SHINGLE)
            sig = signatures(sets, VALUES)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(map(len, sets), pa.int64()),
                    pa.array((hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets), pa.binary()),
                    pa.array((r.tobytes() if len(s) else None for r, s in zip(sig, sets, strict=True)), pa.binary()),
                ],
                ["doc_id", "n_shingles", "key", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, key binary, sig binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every tree the key of each class: the first DEPTH values of the tree's order, two to a number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.int64)
        node = column(batch, "node")
        for t in range(TREES):
            v = sig[:, [(4 * t + k) % VALUES for k in range(DEPTH)]]
            pairs = (v[:, ::2] - (1 << 31)) << 32 | v[:, 1::2]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), *(pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(3)), node], ["tree", "k1", "k2", "k3", "node"])


PAIR, DENSE, EDGE_ROW = 0, 1, 2
FOREST = "kind int, a bigint, b bigint, c bigint, d bigint, e bigint"


def _forest_rows(kind: int, *values: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(values[0]), np.int64)
    columns = [*values, *[zero] * (5 - len(values))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(zero), kind, np.int32)), *(pa.array(np.ascontiguousarray(c, np.int64)) for c in columns)], ["kind", *"abcde"])


def _common(rows: np.ndarray) -> np.ndarray:
    """Values that each sorted row (tree, k1, k2, k3) has in common with the one before; -1 where there is none of its tree."""
    same, out = rows[1:] == rows[:-1], np.full(len(rows), -1, np.int64)
    n = np.zeros(len(rows) - 1, np.int64)
    on = same[:, 0].copy()
    for k in range(1, DEPTH // 2 + 1):
        half = (rows[1:, k] >> 32) == (rows[:-1, k] >> 32)
        n += (on & half).astype(np.int64) + (on & same[:, k])
        on &= same[:, k]
    out[1:] = np.where(same[:, 0], n, -1)
    return out


def near_rows(rows: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j: places of candidates among sorted rows, j not before fresh; and the places of rows in dense regions. Two rows are
    candidates if the region of what they share is small, or if they are neighbours of longest common prefix."""
    lcp, n = _common(rows), len(rows)
    sizes = np.zeros((DEPTH + 1, n), np.int64)
    for d in range(SHALLOW, DEPTH + 1):
        starts = np.flatnonzero(lcp < d)
        sizes[d] = np.repeat(np.diff(np.append(starts, n)), np.diff(np.append(starts, n)))
    shared, found = np.full(n, DEPTH), []
    for step in range(1, min(SMALL, n)):
        i = np.arange(n - step)
        shared = np.minimum(shared[: n - step], lcp[step:])  # of i and i + step: the least in between
        able = shared >= SHALLOW
        small = sizes[np.maximum(shared, SHALLOW), i] <= SMALL
        if step <= NEAR:
            small |= shared >= SURE
        i = i[able & small & (i + step >= fresh)]
        found.append((i, i + step))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    return i, j, np.flatnonzero(sizes[SURE] > SMALL)


def _regions(ends: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates and classes of dense regions, from a range of the sorted orders. The last SMALL rows of a batch go into the
    next one, too: a region that goes on shows its size there. With ends, the first and last SMALL rows are given out, so that
    regions over the ends of ranges are found among those of all ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in joined_batches(batches):
            new = np.stack([np.asarray(column(batch, x)).astype(np.int64) for x in ("tree", "k1", "k2", "k3", "node")], 1)
            if held is None and ends:
                yield _forest_rows(EDGE_ROW, *new[:SMALL].T)
            fresh = 0 if held is None else len(held)
            rows = new if held is None else np.concatenate([held, new])
            i, j, dense = near_rows(rows[:, :4], fresh)
            if len(i):
                pairs = np.unique(np.stack([np.maximum(rows[i, 4], rows[j, 4]), np.minimum(rows[i, 4], rows[j, 4])], 1), axis=0)
                yield _forest_rows(PAIR, *pairs.T)
            if len(dense):
                yield _forest_rows(DENSE, np.unique(rows[dense, 4]))
            held = rows[-SMALL:]
        if held is not None and ends:
            yield _forest_rows(EDGE_ROW, *held.T)

    return run


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), a > b, of classes (node, sig), before any filter; and the classes (node) of dense regions."""
    order = ["tree", "k1", "k2", "k3", "node"]
    keyed = classes.select("node", "sig").mapInArrow(_keys, "tree int, k1 bigint, k2 bigint, k3 bigint, node bigint")
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(ordered.mapInArrow(_regions(True), FOREST), "forest")
    # A few rows for each range of the orders, however many classes there are.
    ends = found.where(F.col("kind") == EDGE_ROW).selectExpr("cast(a as int) as tree", "b as k1", "c as k2", "d as k3", "e as node").distinct()
    over = materialize(ends.repartition(1).sortWithinPartitions(*order).mapInArrow(_regions(False), FOREST), "forest-ends")
    every = found.unionByName(over)
    pairs = every.where((F.col("kind") == PAIR) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    dense = materialize(every.where(F.col("kind") == DENSE).select(F.col("a").alias("node")).distinct(), "dense")
    return pairs, dense


def rare_shingles(sets: DataFrame) -> DataFrame:
    """node, shingle, often: of each set (node, shingles) as many of its rarest shingles as make sure that two sets with a
    similarity of PERCENT share one. Rare is what few of these sets have; often marks what more than SMALL have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "shingles"):
            each = [np.frombuffer(x, np.int64) for x in column(batch, "shingles").to_pylist()]
            sizes = [len(x) for x in each]
            nodes = np.repeat(np.asarray(column(batch, "node")), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.repeat(np.array(sizes, np.int64), sizes)), pa.array(np.concatenate(each) if each else np.empty(0, np.int64))], ["node", "n", "shingle"])

    every = materialize(sets.select("node", "shingles").mapInArrow(run, "node bigint, n bigint, shingle bigint"), "shingles")
    often = materialize(every.groupBy("shingle").agg(F.count("*").alias("times")).where(F.col("times") > SMALL), "often")
    told = every.join(F.broadcast(often) if few(often) else often, "shingle", "left")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(0)), "shingle"))
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    out = materialize(told.withColumn("rank", rank).where(F.col("rank") <= prefix).select("node", "shingle", F.col("times").isNotNull().alias("often")), "rare")
    discard(every)
    return out


def candidates(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) between classes (node, label, n_shingles, key, sig) whose coarse clusters hold all that can be linked."""
    pairs, dense = forest(classes)
    sketch = classes.select("node", "n_shingles", "sig").mapInArrow(_sketch, "node bigint, n bigint, sketch binary")
    sketch = materialize(sketch, "sketches")
    ties = None
    if dense.take(1):
        zero = F.lit(0).cast("bigint")
        members = classes.join(F.broadcast(dense) if few(dense) else dense, "node", "left_semi").select(zero.alias("cluster"), zero.alias("block"), "node", "label", "key")
        rare = rare_shingles(_sets_of(members, docs))
        one, two = (rare.where("not often").select("shingle", F.col("node").alias(x)) for x in "ab")
        pairs = pairs.unionByName(one.join(two, "shingle").where("a > b").select("a", "b")).distinct()
        heads = rare.where("often").groupBy("shingle").agg(F.min("node").alias("b"))
        ties = rare.where("often").join(F.broadcast(heads) if few(heads) else heads, "shingle").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    one, two = (sketch.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    able = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    alike = pairs.join(one, "a").join(two, "b").where(able).select("a", "b", "s_a", "s_b").mapInArrow(_alike, "a bigint, b bigint")
    return alike if ties is None else alike.unionByName(ties)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A byte of each signature value."""
    for batch in batches:
        sig = np.frombuffer(b"".join(column(batch, "sig").to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([column(batch, "node"), column(batch, "n_shingles"), pa.array((r.tobytes() for r in sig), pa.binary())], ["node", "n", "sketch"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(column(batch, x).to_pylist()), np.uint8).reshape(-1, VALUES) for x in ("s_a", "s_b"))
        yield batch.select(["a", "b"]).filter(pa.array(np.count_nonzero(a == b, axis=1) >= AGREE))


def exact_links(sets: list[np.ndarray], probes: int | None = None) -> Union:
    """Union of linked sets, by counting shared shingles through an inverted index. With probes, the last so many are compared
    with the others, and the others not among themselves."""
    u = Union(len(sets))
    residents = len(sets) if probes is None else len(sets) - probes
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets[:residents]) if residents else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(residents), sizes[:residents])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for i in range(0 if probes is None else residents, len(sets)):
        lo, hi = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=residents)
        union = sizes[i] + sizes[:residents] - shared
        for j in np.flatnonzero((100 * shared >= PERCENT * union) & (shared > 0)).tolist():
            if j != i:
                u.join(i, j)
    return u


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between linked classes of each group; rows come sorted by group, residents before probes. Only residents that
    are fresh have been compared with nothing yet."""
    rows = (r for b in batches for r in zip(*(column(b, x).to_pylist() for x in ("cluster", "block", "probe", "node", "shingles")), strict=True))
    for (_, _), group in groupby(rows, key=lambda r: r[:2]):
        nodes, sets, probes, seen = [], [], 0, set()
        for _, _, probe, node, raw in group:
            if node in seen:
                continue
            seen.add(node)
            nodes.append(node), sets.append(np.frombuffer(raw, np.uint64))
            probes += probe == 1
        u = exact_links(sets, probes or None)
        a = [(nodes[i], nodes[r]) for i, r in enumerate(u.roots().tolist()) if r != i]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in a], pa.int64()), pa.array([y for _, y in a], pa.int64())], ["a", "b"])


def _tasks(rows: DataFrame, rows_per_task: int) -> int:
    """Tasks for a table of so many rows; small ones still use every core."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // rows_per_task + 1)


def _solved(rows: DataFrame, name: str) -> DataFrame:
    """Links within groups (cluster, block) of rows: cluster, block, probe, node, shingles."""
    ordered = rows.repartition("cluster", "block").coalesce(_tasks(rows, 2000)).sortWithinPartitions("cluster", "block", "probe", "node")
    return materialize(ordered.select("cluster", "block", "probe", "node", "shingles").mapInArrow(_solve, "a bigint, b bigint"), name)


def _sets_of(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets of classes, from the text of the document that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = shingle_sets(*text_bytes(column(batch, "text")), SHINGLE)
            right = [hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, column(batch, "key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "cluster"), column(batch, "block"), column(batch, "node"), pa.array((s.tobytes() for s in sets), pa.binary())], ["cluster", "block", "node", "shingles"]).filter(pa.array(right))

    texts = docs.select("doc_id", "text")
    labels = members.select(F.col("label").alias("wanted")).distinct()
    if few(labels):  # then only texts that are wanted go through the shuffle
        texts = texts.join(F.broadcast(labels), texts.doc_id.eqNullSafe(labels.wanted), "left_semi")
    joined = members.join(texts, members.label.eqNullSafe(texts.doc_id))
    return joined.select("cluster", "block", "node", "key", "text").mapInArrow(run, "cluster bigint, block bigint, node bigint, shingles binary")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed edges (a, b) between classes (node, label, n_shingles, key, sig) that connect all linked ones."""
    coarse = materialize(components(candidates(classes, docs)).withColumnRenamed("component", "cluster"), "coarse")
    tasks = _tasks(coarse, 100_000)
    sized = materialize(coarse.join(classes.select("node", "label", "n_shingles", "key"), "node").coalesce(tasks), "members")
    totals = sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    totals = totals.withColumn("blocks", F.when((F.col("n") > CLUSTER_CLASSES) | (F.col("shingles") > CLUSTER_SHINGLES), F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / CLUSTER_SHINGLES))).otherwise(1).cast("bigint"))
    totals = materialize(totals.coalesce(tasks), "clusters")
    # A large cluster has over CLUSTER_CLASSES classes or CLUSTER_SHINGLES shingles, so there are few; its members may be many.
    large = totals.where("blocks > 1").select("cluster", "blocks")
    marked = sized.join(totals.where("blocks = 1").select("cluster"), "cluster", "left_anti").join(large, "cluster")
    alone = sized.join(large.select("cluster"), "cluster", "left_anti").withColumn("block", F.lit(0).cast("bigint"))
    cut = marked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    columns = ["cluster", "block", "node", "label", "key"]
    sets = materialize(_sets_of(alone.select(columns).unionByName(cut.select(columns)), docs), "sets")
    resident = sets.withColumn("probe", F.lit(0))
    fresh = _solved(resident, "links")
    if not large.take(1):
        return fresh
    in_large = sets.join(large, "cluster")
    spread = lambda probes: probes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("cluster", "block", "node", "shingles", F.lit(1).alias("probe"))
    targets = in_large.select("cluster", "block", "node", "shingles", F.lit(0).alias("probe"))
    first = in_large.where("block = 0")
    across = _solved(targets.where("block > 0").unionByName(spread(first).where("block > 0")), "links-first")
    so_far = fresh.unionByName(across)
    known = components(so_far).withColumnRenamed("component", "part")
    parts = in_large.select("cluster", "node").distinct().join(known, "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = materialize(parts.coalesce(tasks), "parts")
    most = parts.groupBy("cluster", "part").count().groupBy("cluster").agg(F.max_by("part", F.struct("count", -F.col("part"))).alias("part"))
    minor = in_large.join(parts.join(most, ["cluster", "part"], "left_anti").select("node").distinct(), "node")
    # They meet the blocks that have one of their rarest shingles.
    rare = rare_shingles(in_large).join(in_large.select("cluster", "block", "node"), "node")
    there = rare.select("cluster", "block", "shingle").distinct()
    wanted = rare.join(minor.select("node"), "node", "left_semi").select("cluster", "shingle", "node")
    met = materialize(wanted.join(there, ["cluster", "shingle"]).select("cluster", "block", "node").distinct(), "met")
    probes = minor.select("node", "shingles").join(met, "node").select("cluster", "block", "node", "shingles", F.lit(1).alias("probe"))
    last = _solved(targets.unionByName(probes), "links-minor")
    return so_far.unionByName(last)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    rows = materialize(set_table(docs), "signatures")
    full = rows.where("key is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_shingles", "sig"))
    classes = full.groupBy("key").agg(first.alias("first"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), F.col("first.doc_id").alias("label"), F.col("first.n_shingles").alias("n_shingles"), "key", F.col("first.sig").alias("sig")), "classes")
    comps = materialize(components(links(classes, docs)), "components")
    named = comps.join(classes.select("node", "label"), "node")
    least = named.groupBy("component").agg(F.min("label").alias("component_id"))
    labels = named.join(least, "component").select("node", "component_id")
    of_class = classes.select("node", "key", "label").join(labels, "node", "left").select("key", F.coalesce("component_id", "label").alias("component_id"))
    return _per_row(rows, materialize(of_class, "labels"))


def _per_row(rows: DataFrame, of_class: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """Each row with its class's label. Classes of many equal texts, of which there are few, join by broadcast."""
    counts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    least = hot_share * rows.count()
    hot = materialize(counts.where(F.col("n") > least).join(of_class, "key").select("key", F.col("component_id").alias("hot"), F.lit(True).alias("is_hot")), "hot")
    marked = rows.select("doc_id", "n_shingles", "key").join(F.broadcast(hot), "key", "left")
    of_hot = marked.where("is_hot").select("doc_id", "n_shingles", F.col("hot").alias("component_id"))
    rest = marked.where("is_hot is null").join(of_class, "key", "left").select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = of_hot.unionByName(rest)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs of which no near-duplicate with a smaller doc_id is there; all columns as they are. Of equal doc_ids
    one row of a component stays, null doc_ids give way to others, and rows without words all stay."""
    rows, row = keyed(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias("__component"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    ids = materialize(rows.select("doc_id", row).join(found, row), "component-rows")
    first = ids.groupBy("__component").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = materialize(ids.select(row).join(first, row, "left_anti"), "copies")
    return rows.join(F.broadcast(gone) if few(gone) else gone, row, "left_anti").select(docs.columns)
