import random

import brute
import numpy as np
import pytest
from messy import messy_rows, words

from sedimenta.llm import minhash as M
from sedimenta.llm import queries
from sedimenta.llm.components import Union, components


def check(got, rows):
    want = brute.near_duplicates(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_whole_table(spark, sf_dir, small):
    check(queries.op5_near_duplicates(spark, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in small.collect()])


def group(n=400, seed=11):
    """Near-copies of one text with more and less changes, so that some only hang on a few others; single texts, exact copies."""
    rng = random.Random(seed)
    base = words(150, seed).split()
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((1000 + 7 * i % 997 * 3, " ".join(w)))
    return list(dict(rows).items()) + [(i, words(80, 100 + i // 3)) for i in range(30)]


@pytest.mark.parametrize(("classes", "block"), [(512, 256), (40, 16)])
def test_large_group(spark, monkeypatch, classes, block):
    """The same where a cluster is solved whole and where it is solved in blocks."""
    monkeypatch.setattr(M, "CLUSTER_CLASSES", classes)
    monkeypatch.setattr(M, "BLOCK", block)
    rows = group()
    check(M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect(), rows)


def test_threshold_is_exact(spark):
    """75 of 100 shingles shared is a link, 74 is none."""
    one = [f"w{i}" for i in range(104)]
    rows = []
    for k, shared in enumerate((75, 74)):
        # Both have `shared` shingles in common; the union is 100.
        left, right = one[: shared + 4], [*one[: shared + 4]]
        extra = 100 - shared
        left = left + [f"l{k}{i}" for i in range(extra // 2)]
        right = right + [f"r{k}{i}" for i in range(extra - extra // 2)]
        rows += [(10 * k, " ".join(f"{k}{x}" for x in left)), (10 * k + 1, " ".join(f"{k}{x}" for x in right))]
    check(M.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)
    got = brute.near_duplicates(rows)
    assert got[1][1] == 0 and got[11][1] == 11


def test_messy_table(spark, messy, empty):
    rows = [(r[0], r[1]) for r in messy_rows() if r[0] is not None]
    got = M.near_duplicates(messy).collect()
    assert len(got) == len(messy_rows())
    check([r for r in got if r["doc_id"] is not None], list(dict(rows).items()))
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(5, False)]
    assert M.near_duplicates(empty).count() == 0
    assert M.near_duplicates(messy.where("doc_id < 3")).where("kept").count() == 3
    kept = M.keep_first(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14, 15]


def test_equal_ids_of_different_texts(spark):
    rows = [(1, words(50, 1)), (1, words(50, 2)), (2, words(50, 2)), (None, words(50, 3)), (None, words(50, 4))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = M.near_duplicates(df)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.where("doc_id is not null").collect()) == [(1, 1), (1, 1), (2, 1)]
    assert M.keep_first(df).count() == 4


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [*rng.integers(0, 300, (250, 2)).tolist(), *([i, i + 1] for i in range(1000, 1100)), [5, 5]]
    u = Union(1101)
    for a, b in edges:
        u.join(a, b)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    for per_task in (1 << 20, 60):
        assert {r["node"]: r["component"] for r in components(df, edges_per_task=per_task).collect()} == {x: u.find(x) for x in nodes}
    assert components(df.where("false")).count() == 0


def linked_pairs(rows):
    sets = {i: brute.shingles(t) for i, t in rows}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                yield a, b


def classes_of(spark, rows):
    """classes as near_duplicates() makes them, of texts that all differ, each with its doc_id as its node."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return docs, M.set_table(docs).where("key is not null").select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"), "n_shingles", "key", "sig").cache()


def shared_passage(n=70, seed=21):
    """Texts of which half is one passage, so that regions are dense with texts that aren't linked, each with one near-copy."""
    rng, rows = random.Random(seed), []
    passage = words(80, seed).split()
    for i in range(n):
        own = words(80, 1000 + i).split()
        w = passage + own
        rows.append((2 * i, " ".join(w)))
        for k in rng.sample(range(160), 4):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((2 * i + 1, " ".join(w)))
    return rows


def test_recall_of_candidates(spark):
    """Linked pairs against all pairs: sparse regions give them as pairs; where regions are dense, clusters hold all of them."""
    rng, rows = random.Random(12), []
    for i in range(150):
        w = words(120, 500 + i).split()
        for _ in range(4):
            for k in rng.sample(range(120), 1):
                w[k] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    for sparse, table in ((True, rows), (False, shared_passage()), (False, list({t: (i, t) for i, t in group()}.values()))):
        docs, classes = classes_of(spark, table)
        want = set(linked_pairs([(i, t) for i, t in table]))
        pairs, dense = M.forest(classes)
        found = {(r["b"], r["a"]) for r in pairs.collect()}
        assert len(want) > 60
        if sparse:
            assert len(want & found) >= 0.99 * len(want) and len(found) < 3 * len(want) and dense.count() == 0
        else:
            assert dense.count() > M.SMALL
        cluster = {r["node"]: r["component"] for r in components(M.candidates(classes, docs)).collect()}
        assert all(cluster.get(a, a) == cluster.get(b, b) for a, b in want)


def test_dense_regions_of_unlinked_texts(spark, monkeypatch):
    """A passage that all share chains none of them; the near-copy of each is found among them."""
    rows = shared_passage()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(M.near_duplicates(df).collect(), rows)
    docs, classes = classes_of(spark, rows)
    clusters = components(M.candidates(classes, docs)).groupBy("component").count()
    assert clusters.agg({"count": "max"}).first()[0] < len(rows) / 4


def test_region_sizes():
    """Candidates of sorted rows against a plain reading of the rule, also where rows come in two parts."""
    rng = np.random.default_rng(4)
    keys = rng.choice([0, 1, 1, 1], (300, 7)).astype(np.int64)
    keys[:, 0] = rng.integers(0, 2, 300)
    keys = keys[np.lexsort(keys.T[::-1])]
    rows = np.stack([keys[:, 0], *(keys[:, k] << 32 | keys[:, k + 1] for k in (1, 3, 5))], 1)
    i, j, dense = M.near_rows(rows, 0)
    lcp = lambda a, b: -1 if keys[a, 0] != keys[b, 0] else next((k for k in range(6) if keys[a, k + 1] != keys[b, k + 1]), 6)
    size = lambda a, d: sum(lcp(a, x) >= d for x in range(300))
    want = {(a, b) for a in range(300) for b in range(a + 1, min(a + M.SMALL, 300)) if (m := lcp(a, b)) >= 2 and (size(a, m) <= M.SMALL or b - a <= M.NEAR and m >= M.SURE)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert set(dense.tolist()) == {a for a in range(300) if size(a, M.SURE) > M.SMALL}


def test_ids_of_other_types(spark):
    rows = [("b", words(50, 1)), ("a", words(50, 1)), ("c", words(50, 2)), (None, None)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {("b", "a", False), ("a", "a", True), ("c", "c", True), (None, None, True)}
