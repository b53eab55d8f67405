import hashlib
import random

import brute
import numpy as np
import pytest
from messy import messy_rows, words

from sedimenta.llm import queries
from sedimenta.llm import suffix_dedup as D


def key(r):
    return tuple((x is None, x) for x in r)


def digests(rows, length=400):
    told = brute.removal(rows, D.PASSAGE)
    return sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest(), p[3], p[2]) for r, p in zip(brute.removal(rows, length), told, strict=True)), key=key)


def test_sorted_rows():
    """Order and common prefixes of suffixes against plain sorting."""
    rng = np.random.default_rng(0)
    for trial in range(60):
        m, n = int(rng.integers(1, 25)), 8 * int(rng.integers(1, 8))
        a = rng.integers(0, 2, (m, n)).astype(np.uint8)
        if trial % 3 == 0:
            a = a[rng.integers(0, m, m)]
        order, common = D.sorted_rows(a)
        rows = [a[i].tobytes() for i in order]
        assert rows == sorted(rows)
        for i in range(1, m):
            assert common[i] == next((k for k in range(n) if rows[i][k] != rows[i - 1][k]), n)
        words_ = np.ascontiguousarray(a).view(">u8").astype(np.uint64)
        rank = D.suffix_ranks(words_)
        suffixes = sorted(tuple(words_[i, k:].tolist()) for i in range(m) for k in range(n // 8))
        assert all(suffixes[rank[i, k] - 1] == tuple(words_[i, k:].tolist()) for i in range(m) for k in range(n // 8))


def test_merged_lists():
    rng = np.random.default_rng(1)
    lists = [np.array(sorted(map(tuple, rng.integers(0, 30, (n, 2)).tolist()))).astype(np.uint64).reshape(-1, 2) for n in (10, 60, 0, 5, 200)]
    for i, seen in enumerate(D.merge_lists(lists)):
        others = {tuple(r) for j, x in enumerate(lists) if j != i for r in x.tolist()}
        assert seen.tolist() == [tuple(r) in others for r in lists[i].tolist()]


def test_whole_table(spark, sf_dir, small):
    want = digests([(r["doc_id"], r["text"]) for r in small.collect()])
    assert sorted((tuple(r) for r in queries.op3_repeated_substrings(spark, sf_dir).collect()), key=key) == want
    assert any(r[2] for r in want)


@pytest.mark.parametrize(("spread", "broadcast", "step"), [(4096, 16 << 20, 1 << 20), (1, 0, 1000)])
def test_messy_table(spark, messy, empty, monkeypatch, spread, broadcast, step):
    """Also where every anchor is spread over shards, nothing is broadcast, and long texts go in short steps."""
    monkeypatch.setattr(D, "SPREAD", spread)
    monkeypatch.setattr(D, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(D, "SHARD_BYTES", 1 << 14)
    monkeypatch.setattr(D, "RANGE", 500)
    rows = [(r[0], r[1]) for r in messy_rows()]
    assert sorted((tuple(r) for r in D.removal_digests(messy).collect()), key=key) == digests(rows)
    assert D.removal_digests(empty).count() == 0
    out = D.keep_unique(messy)
    assert out.columns == messy.columns
    kept = sorted(("" if r[4] is None else r[4].decode(errors="ignore") for r in brute.removal(rows)))
    assert sorted(r["text"] or "" for r in out.collect()) == kept
    assert out.where("text is null").count() == sum(t is None for _, t in rows)


def test_steps_of_a_long_text(monkeypatch):
    """A text looked at in steps gives windows that are told alike."""
    text = (words(600, 7) + " ").encode()
    whole = {(p, s) for _, _, p, lo, hi in zip(*D.contexts(text), strict=True) for s in range(lo, hi + 1)}
    monkeypatch.setattr(D, "STEP", 700)
    assert {(p, s) for _, _, p, lo, hi in zip(*D.contexts(text), strict=True) for s in range(lo, hi + 1)} == whole
    assert {s for _, s in whole} == set(range(len(text) - 399))


def test_edges_and_runs(spark):
    """Repeats of 399, 400 and 401 bytes, periodic texts, near-copies by the dozen, copies of characters of several bytes."""
    rng = random.Random(6)
    a, b = words(400, 8), words(400, 9)
    rows = [(0, a), (1, "x" + b[:10] + a[100:499] + "y"), (2, "z" + a[1000:1400]), (3, "w" + a[1500:1901] + "é"), (4, "ab" * 700), (5, "ab" * 199 + "a"), (6, "ü" * 300), (7, "ü" * 201), (8, b), (9, b[:399])]
    base = words(150, 10).split()
    for i in range(30):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((10 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in D.removal_digests(df).collect()), key=key) == digests(rows)


@pytest.mark.parametrize("length", [250, 401])
def test_other_lengths(spark, messy, length):
    """The length is a parameter, also one that is no multiple of the words that suffixes are sorted by."""
    rows = [(r[0], r[1]) for r in messy_rows()]
    assert sorted((tuple(r) for r in D.removal_digests(messy, length).collect()), key=key) == digests(rows, length)


def test_passages_by_words(spark):
    """Repeated runs of 50 and 51 words, one of 51 short words, and 399 (with spaces around) and 400 bytes that no space divides."""
    own = iter(range(100, 200))
    wrap = lambda p: words(20, next(own)) + " " + p + " " + words(20, next(own))
    fifty, more, short = (" ".join(f"{c}{i:04d}" for i in range(n)) for c, n in (("q", 48), ("r", 51), ("s", 51)))
    short = " ".join(w[0] + w[2:] for w in short.split())
    rng = random.Random(3)
    solid = "".join(rng.choice("abcdefghij") for _ in range(397))
    rows = [(i, wrap(p)) for i, p in enumerate([fifty, fifty, more, more, short, short, solid, solid])] + [(8, solid + "xyz"), (9, solid + "xyz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i: kept.decode(errors="ignore") for i, _, _, _, kept in brute.removal(rows, 200, 50)}
    assert {r["doc_id"]: r["text"] for r in D.keep_unique(df, 200, 50).collect()} == want
    texts = dict(rows)
    assert [want[i] == texts[i] for i in range(10)] == [True, True, False, False, False, False, True, True, False, False]
    assert sorted((tuple(r) for r in D.removal_digests(df).collect()), key=key) == digests(rows)


def test_names_of_a_users_columns(spark):
    df = spark.createDataFrame([(1, words(100, 1), 5, 6), (1, words(100, 1), 5, 6)], "doc_id bigint, text string, __ROW int, __removed int")
    out = D.keep_unique(df).collect()
    assert [tuple(r) for r in out] == [(1, "", 5, 6)] * 2
