"""Removal of repeated substrings by sharded suffix arrays.

Every byte goes that some string of `length` bytes covers which also starts anywhere else. Texts are UTF-8 bytes, matches
never cross texts, overlaps count, and strings are judged on the input. The length is a parameter, LENGTH by default.

1. Each window of that length has an anchor: of the strings of half its length in it the one with the smallest hash. Equal
   windows have equal anchors at equal places, so a window can only repeat where its anchor does. Neighbouring windows
   mostly share one; together they are the context of that anchor. Anchors that occur once are done with.
2. Contexts that are equal as a whole repeat in all their windows. One of each kind, with its number, goes on where an
   anchor has contexts of several kinds.
3. Contexts are dealt into shards by anchor. In a shard, what follows each anchor, and backwards what precedes it, are
   sorted as suffixes: ranks of words are refined by doubling, only groups that still tie are sorted again
   (Larsson-Sadakane), and common prefixes follow from each suffix to the next one (Kasai), all contexts in step. Two
   windows d bytes before their anchor are equal if their contexts agree on d bytes backwards and length - d forwards.
4. An anchor of very many contexts is spread over shards. These give out the sorted fingerprints of the windows they know,
   cut by ranges; for each range the lists of shards are merged by binary search in each other.
5. The repeated windows of a text are united and cut out. keep_unique() can be held to runs of more than some words: of
   the maximal runs that shorter strings cover, those of more words are cut out, and those of LENGTH bytes, however few
   words they have, since not every script sets words apart.

A null text is empty. Repeated rows are copies like any other: a text of that length or more that occurs twice goes
whole. Null or repeated doc_ids get their own rows. Other columns pass through keep_unique() untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import column, discard, few, free_name, keyed, materialize, small_batches
from sedimenta.llm.shingles import mix

LENGTH = 400

#: Length of the passages that removal_digests() tells of besides: 51 words of the four languages of the tables have at least
#: so many bytes in 98 of 100 places.
PASSAGE = 250


def gram(length: int) -> int:
    """Bytes of an anchor."""
    return length // 2


def width(length: int) -> int:
    """Places that an anchor can have in a window."""
    return length - gram(length) + 1


#: Bytes of a text that are looked at in one step, and of contexts in a shard.
STEP, SHARD_BYTES = 1 << 18, 3 << 20

#: An anchor of more kinds of contexts is spread over shards.
SPREAD = 4096

#: Fingerprints in a range when shards are merged.
RANGE = 1 << 20

#: Bytes that a broadcast table of keys may take on each executor; KEY_BYTES a row, as a hash relation of one or two longs
#: takes them at the most.
BROADCAST_BYTES, KEY_BYTES = 16 << 20, 80

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POSITION = np.uint64((1 << 28) - 1)
_MAX = np.uint64(2**64 - 1)


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    inverse = pow(base, -1, 2**64)
    return (np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse))


class Rolling:
    """Hashes of any substring of a text of at most n bytes, in constant time each."""

    def __init__(self, n: int, base: int = _BASES[0]):
        self.power, self.inverse = _tables(base, n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=s[1:])
        return s

    def between(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((sums[hi] - sums[lo]) * self.inverse[lo])


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours, by running minima from both ends of blocks."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, _MAX)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()[:n]
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()[:n]
    return np.minimum(back[: n - width + 1], ahead[width - 1 :])


_rolling: dict[tuple[int, int], Rolling] = {}


def _roll(n: int, base: int = 0) -> Rolling:
    """Tables for texts of n bytes, made once in each worker."""
    if (n, base) not in _rolling:
        _rolling[n, base] = Rolling(n, _BASES[base])
    return _rolling[n, base]


def contexts(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchor, kind, place, lo, hi: for each run of windows with one anchor its hash, the hash of the context, its place, and
    the first and last start of a window."""
    roll, parts, size = _roll(STEP + length), [], gram(length)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - length + 1, STEP):
        piece = data[at : at + STEP + length - 1]
        sums = roll.sums(piece)
        n = len(piece) - size + 1
        h = mix((sums[size:] - sums[:-size]) * roll.inverse[:n])
        least = _window_least((h & ~_POSITION) | np.arange(n, dtype=np.uint64), width(length)) & _POSITION
        lo = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        hi = np.append(lo[1:], len(least)) - 1
        place = least[lo].astype(np.int64)
        kind = roll.between(sums, lo, hi + length)
        kind = mix(kind + ((place - lo).astype(np.uint64) << np.uint64(32)) + (hi - lo).astype(np.uint64))
        parts.append((h[place], kind, place + at, lo + at, hi + at))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _raw(text: str | bytes | None) -> bytes:
    return text.encode() if isinstance(text, str) else text or b""


def anchor_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, anchor, kind, place, lo, hi of every context of docs (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows, found = [], []
            for row, text in zip(column(batch, "row").to_pylist(), column(batch, "text").to_pylist(), strict=True):
                c = contexts(_raw(text), length)
                rows.append(np.full(len(c[0]), row, np.int64)), found.append(c)
            anchor, kind, place, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            ints = (pa.array(x.astype(np.int32)) for x in (place, lo, hi))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), *ints], ["row", "anchor", "kind", "place", "lo", "hi"])

    return docs.select("row", "text").mapInArrow(run, "row bigint, anchor bigint, kind bigint, place int, lo int, hi int")


def suffix_ranks(words: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of the rows of words (rows, n), each the place of its group in sorted order; equal ones share it.
    A suffix ends with its row. Groups of one keep their rank, the others are sorted again by the ranks h words on."""
    m, n = words.shape
    flat = words.ravel()
    order = np.argsort(flat, kind="stable")
    head = np.append(True, flat[order][1:] != flat[order][:-1])
    rank = np.empty(m * n, np.int64)
    place = np.maximum.accumulate(np.where(head, np.arange(m * n), 0))
    rank[order] = place + 1
    size = np.diff(np.append(np.flatnonzero(head), m * n))
    open_ = order[np.repeat(size > 1, size)]
    h, total = 1, m * n + 2
    while h < n and len(open_):
        on = open_ % n + h < n
        key = rank[open_] * total
        key[on] += rank[open_[on] + h]
        o = np.argsort(key, kind="stable")
        open_, key = open_[o], key[o]
        group = key // total
        new = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(key)), 0))
        start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[open_] = group + start - first
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return rank.reshape(m, n)


def common_prefixes(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words that each suffix has in common with the one before it in sorted order, in that order; 0 for the first. Each
    suffix has at least one word less in common than the suffix one word longer: so the rows go on together, word by word."""
    m, n = words.shape
    order = np.argsort(rank.ravel(), kind="stable")
    before = np.empty(m * n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    flat, h = words.ravel(), np.zeros(m, np.int64)
    out = np.zeros(m * n, np.int64)
    base = np.arange(m) * n
    for k in range(n):
        at = base + k
        other = before[at]
        h = np.where(other < 0, 0, np.maximum(h - 1, 0))
        room = np.minimum(n - k, n - other % n)
        live = np.flatnonzero((other >= 0) & (h < room))
        while len(live):
            live = live[flat[at[live] + h[live]] == flat[other[live] + h[live]]]
            h[live] += 1
            live = live[h[live] < room[live]]
        out[at] = h
    return out[order]


def sorted_rows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes (rows, a multiple of 8), and the bytes that each has in common with the one before."""
    words = np.ascontiguousarray(data).view(">u8").astype(np.uint64)
    m, n = words.shape
    rank = suffix_ranks(words)
    shared = common_prefixes(words, rank)
    every = np.argsort(rank.ravel(), kind="stable")
    at = np.flatnonzero(every % n == 0)
    order = every[at] // n
    common = np.zeros(m, np.int64)
    if m > 1:
        # The least of what lies between two whole rows in the order of all suffixes.
        common[1:] = np.minimum.reduceat(shared, at[:-1] + 1)[: m - 1] if at[-1] + 1 > len(shared) - 1 else np.minimum.reduceat(np.append(shared, 0)[: at[-1] + 1], at[:-1] + 1)
    out = common * 8
    part = np.flatnonzero((common < n) & (np.arange(m) > 0))
    diff = words[order[part], common[part]] ^ words[order[part - 1], common[part]]
    out[part] += sum((diff >> np.uint64(8 * k)) == 0 for k in range(1, 8))
    return order, out


class Shard:
    """Contexts of some anchors: bytes, place of the anchor in each, and how many of the kind there are."""

    def __init__(self, texts: list[bytes], lead: np.ndarray, times: np.ndarray, length: int = LENGTH):
        self.lead, self.times, self.m, self.length, self.width = lead, times, len(texts), length, width(length)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.least = lead - (self.size - length)  # of the distances at which windows start before the anchor
        self.data = np.zeros((self.m, length + self.width + 7), np.uint8)
        for i, t in enumerate(texts):
            self.data[i, : len(t)] = np.frombuffer(t, np.uint8)

    def classes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each distance d the contexts that have such a window, and a number for each that equal windows share."""
        cols = np.arange(-(-self.length // 8) * 8)[None, :]
        at = np.minimum(self.lead[:, None] + cols, self.data.shape[1] - 1)
        right = np.where(self.lead[:, None] + cols < self.size[:, None], np.take_along_axis(self.data, at, 1), 0).astype(np.uint8)
        back = self.lead[:, None] - 1 - np.arange(-(-self.width // 8) * 8)[None, :]
        left = np.where(back >= 0, np.take_along_axis(self.data, np.maximum(back, 0), 1), 0).astype(np.uint8)
        (ro, rc), (lo, lc) = sorted_rows(right), sorted_rows(left)
        ra, la = np.empty(self.m, np.int64), np.empty(self.m, np.int64)
        for d in range(self.width):
            able = np.flatnonzero((self.least <= d) & (d <= self.lead))
            if len(able):
                ra[ro] = np.cumsum(rc < self.length - d)
                la[lo] = np.cumsum(lc < d)
                yield d, able, ra[able] * (self.m + 1) + la[able]

    def repeated(self) -> np.ndarray:
        """(contexts, width): whether the window that starts d bytes before the anchor occurs again in the shard."""
        out = np.zeros((self.m, self.width), bool)
        for d, able, number in self.classes():
            _, inverse = np.unique(number, return_inverse=True)
            out[able, d] = np.bincount(inverse, self.times[able])[inverse] > 1
        return out

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of every window, with its context and distance as one number."""
        i, d = np.nonzero((self.least[:, None] <= np.arange(self.width)) & (np.arange(self.width) <= self.lead[:, None]))
        start = self.lead[i] - d
        got = []
        for k in (0, 1):
            roll = _roll(self.length + self.width + 8, k)
            sums = np.zeros((self.m, self.data.shape[1] + 1), np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * roll.power[: self.data.shape[1]], axis=1, out=sums[:, 1:])
            got.append(mix((sums[i, start + self.length] - sums[i, start]) * roll.inverse[start]))
        return got[0], got[1], i * self.width + d


def _intervals(marks: np.ndarray) -> np.ndarray:
    """(runs, 2): first and last place of each run of true."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1)


FOUND = "row bigint, lo int, hi int, range int, shard bigint, prints binary, windows binary"


def _found(rows: list, lo: list, hi: list) -> pa.RecordBatch:
    n, i32 = len(rows), pa.int32()
    empty = [pa.array([None] * n, t) for t in (i32, pa.int64(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lo, i32), pa.array(hi, i32), *empty], [x.split()[0] for x in FOUND.split(", ")])


def _solver(ranges: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("shard", "spread", "row", "place", "lo", "times", "text")
        rows = (r for b in batches for r in zip(*(column(b, x).to_pylist() for x in names), strict=True))
        for (shard, spread), group in groupby(rows, key=lambda r: r[:2]):
            group = list(group)
            lead = np.array([r[3] - r[4] for r in group], np.int64)
            times = np.array([r[5] for r in group], np.int64)
            s = Shard([r[6] for r in group], lead, times, length)
            marks = s.repeated()
            out: tuple[list, list, list] = ([], [], [])
            for i in np.flatnonzero((times == 1) & marks.any(1)).tolist():
                for a, b in _intervals(marks[i]).tolist():  # distances a..b before the anchor
                    out[0].append(group[i][2]), out[1].append(group[i][3] - b), out[2].append(group[i][3] - a)
            if out[0]:
                yield _found(*out)
            if not spread:
                continue
            one, two, at = s.fingerprints()
            start = np.array([r[3] for r in group], np.int64)[at // s.width] - at % s.width
            owner = np.where(times[at // s.width] == 1, np.array([r[2] for r in group], np.int64)[at // s.width], -1)
            part = (one >> np.uint64(33)).astype(np.int64) * ranges >> 31
            order = np.lexsort((two, one))
            order = order[np.argsort(part[order], kind="stable")]
            bounds = np.searchsorted(part[order], np.arange(ranges + 1))
            for r in range(ranges):
                o = order[bounds[r] : bounds[r + 1]]
                if len(o):
                    prints = np.stack([one[o], two[o]], 1).tobytes()
                    windows = np.stack([owner[o], start[o]], 1).astype(np.int64).tobytes()
                    values = ([None], pa.int64()), ([None], pa.int32()), ([None], pa.int32()), ([r], pa.int32()), ([shard], pa.int64()), ([prints], pa.binary()), ([windows], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], [x.split()[0] for x in FOUND.split(", ")])

    return run


def merge_lists(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each sorted list of fingerprints whether its members are in another one too, by binary search in the others. The
    second hash decides where the first ones agree: lists hold both as one key of 16 bytes."""
    keys = [np.ascontiguousarray(x.astype(">u8")).view("S16").ravel() for x in lists]
    level = [(u := np.unique(k), np.zeros(len(u), bool)) for k in keys]
    while len(level) > 1:
        level = [_merge_two(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return [level[0][1][np.searchsorted(level[0][0], k)] for k in keys]


def _merge_two(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of distinct keys as one, and which keys are in several of the lists that went in."""
    (a, several), (b, also) = one, two
    at = np.searchsorted(a, b)
    hit = np.zeros(len(b), bool)
    if len(a):
        hit = a[np.minimum(at, len(a) - 1)] == b
    several = several.copy()
    several[at[hit]] = True
    return np.insert(a, at[~hit], b[~hit]), np.insert(several, at[~hit], also[~hit])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(column(b, x).to_pylist() for x in ("range", "prints", "windows")), strict=True))
    for _, group in groupby(rows, key=lambda r: r[0]):
        group = list(group)
        lists = [np.frombuffer(p, np.uint64).reshape(-1, 2) for _, p, _ in group]
        for (_, _, w), seen in zip(group, merge_lists(lists), strict=True):
            w = np.frombuffer(w, np.int64).reshape(-1, 2)[seen]
            w = w[w[:, 0] >= 0]
            if len(w):
                start = pa.array(w[:, 1].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, 0])), start, start], ["row", "lo", "hi"])


def _keys(df: DataFrame) -> DataFrame:
    """Numbers of rows whose texts are wanted, to be broadcast if they surely take at most BROADCAST_BYTES, so that other texts
    aren't shuffled; else Spark joins by shuffle."""
    return F.broadcast(df) if few(df, BROADCAST_BYTES // KEY_BYTES) else df


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, lo, hi: runs of starts of windows that occur again, of docs (row, text as string or bytes). Tables of anchors grow with the corpus:
    they are joined by shuffle at every size, but where Spark knows one to be small."""
    every = materialize(anchor_table(docs, length), "anchors")
    often = materialize(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    again = materialize(every.join(often, "anchor", "left_semi"), "again")
    discard(every), discard(often)
    first = F.min(F.struct("row", "place", "lo", "hi")).alias("first")
    kinds = materialize(again.groupBy("anchor", "kind").agg(F.count("*").alias("times"), first), "kinds")
    per = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    per = materialize(per.select("anchor", "kinds"), "per-anchor")
    # Windows of contexts of which there are several.
    several = materialize(kinds.where("times > 1").select("anchor", "kind"), "several")
    whole = materialize(again.join(several, ["anchor", "kind"], "left_semi").select("row", "lo", "hi"), "whole")
    discard(again), discard(several)
    # One of each kind where an anchor has several.
    sent = materialize(kinds.join(per, "anchor").select("anchor", "kind", "kinds", "times", "first.*"), "sent")
    discard(kinds), discard(per)
    size = sent.agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0]
    if not size:
        return whole
    shards = max(1, -(-size // SHARD_BYTES))
    key = F.when(F.col("kinds") > SPREAD, F.xxhash64("anchor", "kind")).otherwise(F.xxhash64("anchor"))
    lists = sent.withColumn("shard", F.pmod(key, F.lit(shards))).withColumn("spread", F.col("kinds") > SPREAD)
    lists = lists.groupBy("row").agg(F.collect_list(F.struct("shard", "spread", "place", "lo", "hi", "times")).alias("wanted"))
    rows = materialize(sent.select("row").distinct(), "sent-rows")
    texts = docs.join(_keys(rows), "row", "left_semi").select("row", "text")
    cut = lists.join(texts, "row").select("row", "text", "wanted").mapInArrow(_cutter(length), "shard bigint, spread boolean, row bigint, place int, lo int, times bigint, text binary")
    ordered = cut.repartition("shard", "spread").sortWithinPartitions("shard", "spread")
    spread = sent.where(F.col("kinds") > SPREAD).agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    found = materialize(ordered.mapInArrow(_solver(max(1, -(-spread // RANGE)), length), FOUND), "found")
    discard(sent), discard(rows)
    out = whole.unionByName(found.where("range is null").select("row", "lo", "hi"))
    if spread:
        merged = found.where("range is not null").select("range", "shard", "prints", "windows").repartition("range").sortWithinPartitions("range", "shard")
        out = out.unionByName(materialize(merged.mapInArrow(_merge, "row bigint, lo int, hi int"), "merged"))
    return out


def _cutter(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the wanted contexts out of texts."""
    names = ["shard", "spread", "row", "place", "lo", "times", "text"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    put = lambda out: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[tuple] = []
            for row, text, wanted in zip(*(column(batch, x).to_pylist() for x in ("row", "text", "wanted")), strict=True):
                raw = _raw(text)
                for w in wanted:
                    out.append((w["shard"], w["spread"], row, w["place"], w["lo"], w["times"], raw[w["lo"] : w["hi"] + length]))
                    if len(out) > 10_000:
                        yield put(out)
                        out = []
            if out:
                yield put(out)

    return run


def spans(lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(spans, 2): the bytes that windows starting at lo..hi cover, united; ends are exclusive."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.append(True, lo[1:] > end[:-1])
    return np.stack([lo[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]], 1)


def _united(found: DataFrame, length: int) -> DataFrame:
    """row and spans, the starts and ends of what runs of windows (row, lo, hi) cover, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [spans(np.array([w["lo"] for w in ws]), np.array([w["hi"] for w in ws]), length).ravel() for ws in column(batch, "ws").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(out, pa.list_(pa.int64()))], ["row", "spans"])

    grouped = found.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ws"))
    return materialize(grouped.mapInArrow(run, "row bigint, spans array<bigint>"), "spans")


def span_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row and spans of what repeats in docs (row, text); rows of which nothing does aren't there."""
    return _united(repeated_windows(docs, length), length)


def spans_within(docs: DataFrame, shorter: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same, where spans for a smaller length are known: what repeats at this length lies within one of those, wherever it
    occurs, so they alone are searched, each as a text of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for row, text, ends in zip(*(column(batch, x).to_pylist() for x in ("row", "text", "spans")), strict=True):
                raw = text.encode()
                out += [(row, a, raw[a:b]) for a, b in zip(ends[::2], ends[1::2], strict=True) if b - a >= length]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "at", "text"])

    able = shorter.where(F.expr(f"exists(sequence(0, size(spans) - 2, 2), i -> spans[i + 1] - spans[i] >= {length})"))
    texts = docs.join(_keys(able.select("row")), "row", "left_semi").select("row", "text")
    cut = texts.join(able, "row").select("row", "text", "spans").mapInArrow(run, "doc bigint, at bigint, text binary")
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    found = repeated_windows(pieces.select("row", "text"), length).join(pieces.select("row", "doc", "at"), "row")
    return _united(found.select(F.col("doc").alias("row"), (F.col("lo") + F.col("at")).alias("lo"), (F.col("hi") + F.col("at")).alias("hi")), length)


def attached(docs: DataFrame, row: str, table: DataFrame) -> DataFrame:
    """docs, whose rows are numbered by row, with the arrays of table (row and arrays), empty where it has none. Texts that it
    doesn't name need not meet it in a shuffle, as long as the rows that it does are few enough to tell."""
    names = [c for c in table.columns if c != "row"]
    own = table.withColumnRenamed("row", row)
    none = F.array().cast("array<bigint>")
    filled = lambda df: df.withColumns({c: F.coalesce(c, none) for c in names})
    rows = own.select(row)
    if not few(rows, BROADCAST_BYTES // KEY_BYTES):
        return filled(docs.join(own, row, "left"))
    touched = filled(docs.join(F.broadcast(rows), row, "left_semi").join(own, row))
    return touched.unionByName(docs.join(F.broadcast(rows), row, "left_anti").withColumns({c: none for c in names}))


def _kept(raw: bytes, removed: list[int]) -> bytes:
    cuts = [0, *removed, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def removal_digests(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; further n_passages and n_passage_bytes: the maximal runs
    of bytes that repeated strings of passage bytes, a smaller length, cover. Those are told and not removed."""
    if passage > length:
        raise ValueError("a passage must not be longer than what is removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = []
            for text, removed, told in zip(*(column(batch, x).to_pylist() for x in ("text", "removed", "passages")), strict=True):
                raw = (text or "").encode()
                kept = _kept(raw, removed)
                out.append((len(raw), len(raw) - len(kept), len(removed) // 2, hashlib.sha256(kept).hexdigest(), len(told) // 2, sum(told[1::2]) - sum(told[::2])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered, row = keyed(docs.select("doc_id", "text"))
    texts = numbered.select(F.col(row).alias("row"), "text")
    passages = span_table(texts, passage)
    table = passages.withColumnRenamed("spans", "passages").join(spans_within(texts, passages, length).withColumnRenamed("spans", "removed"), "row", "left")
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_bytes bigint"
    return attached(numbered, row, materialize(table, "passages")).select("doc_id", "text", "removed", "passages").mapInArrow(run, schema)


def passages_of(raw: bytes, ends: list[int], words: int, length: int = LENGTH) -> list[int]:
    """Of the maximal runs (starts and ends, one after the other) those of more than so many words, or of length bytes. Words
    are what ASCII white space sets apart; parts of words at the ends of a run count."""
    kept = ((a, b) for a, b in zip(ends[::2], ends[1::2], strict=True) if b - a >= length or len(raw[a:b].split()) > words)
    return [x for run in kept for x in run]


def _cut(text: str, ends: list[int], words: int | None) -> str:
    raw = text.encode()
    return _kept(raw, ends if words is None else passages_of(raw, ends, words)).decode("utf-8", "ignore")


def keep_unique(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The rows with what is left of their texts, all other columns as they are. Of the maximal runs that repeated strings of
    length bytes cover all go or, where words are given, those of more than so many and those of
    LENGTH bytes. Bytes of a character of which a part goes are dropped, and a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            gone = column(batch, removed).to_pylist()
            texts = [t if t is None or not r else _cut(t, r, words) for t, r in zip(column(batch, "text").to_pylist(), gone, strict=True)]
            names = [x for x in batch.schema.names if x != removed]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if x == "text" else column(batch, x) for x in names], names)

    numbered, row = keyed(docs)
    removed = free_name(docs, "__removed")
    found = span_table(numbered.select(F.col(row).alias("row"), "text"), length).withColumnRenamed("spans", removed)
    return attached(numbered, row, found).select(*docs.columns, removed).mapInArrow(run, docs.schema)
