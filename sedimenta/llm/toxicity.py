"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities and rates of a whole text: words of a fixed lexicon and of one learned from labels, also where
letters are replaced (id1ot, st*pid), their distance to words of second person, capitals, punctuation, obfuscated words.
Trees, learned lexicon and calibration are fitted on a bounded sample of labelled rows outside the held-out fold: at most
sample_rows ids of each label, those with the smallest hash, one text an id, none over LONG characters, and no more of a
label once they have sample_chars. Everything else covers all rows and whole texts.

A null text counts as empty; it gets the score that its features, all 0, have. doc_ids may have any type; those with
several labels count as toxic if one says so, and of those with several texts one is in the sample. Without both labels in
the sample the score is that of the fixed lexicon. Repeated rows are scored alike. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import column, materialize, small_batches

#: The sample: ids and characters of a label, and characters of the longest text in it.
SAMPLE_ROWS, SAMPLE_CHARS, LONG = 2000, 16_000_000, 50_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MEMO_WORDS = 250_000

#: Words a text is searched for whatever the labels say: common insults.
LEXICON = frozenset("idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown clowns disgusting dumb jerk fool imbecile".split())

#: Words that address a reader, in the four languages of the tables.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros os".split())

#: What stands for a letter in obfuscated words.
LEET = str.maketrans("013457@$!|", "oieastasil")

#: Words between an insult and a word of second person that still count as near.
NEAR = 5

#: Lengths of word beginnings that the learned lexicon may hold.
STEMS = (4, 5, 6)

BASE, LEARNED, STEM, PERSON, OBFUSCATED, MASKED = 1, 2, 4, 8, 16, 32
NAMES = ["words", "base", "base_density", "learned", "learned_density", "stem", "stem_density", "masked", "masked_density", "near", "person_density", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "any"]

_EDGES = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_ODD = re.compile(r"(?<=\w)[\d@$!*|](?=\w)|(?<=\w)[.\-_](?=\w[.\-_]\w)")


def _class_table() -> np.ndarray:
    """Per byte: 1 for a capital of ASCII, 2 for a small letter, 3 for an exclamation mark, 4 for other marks, else 0."""
    t = np.zeros(256, np.uint8)
    t[33:48] = t[58:65] = t[91:97] = t[123:127] = 4
    t[65:91], t[97:123], t[33] = 1, 2, 3
    return t


@dataclass
class Lexicon:
    learned: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()


@dataclass
class Featurizer:
    """Dense features of whole texts. Each distinct word is looked at once for a bounded memo."""

    lexicon: Lexicon
    memo: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=_class_table)

    def flags(self, token: str) -> int:
        word = _EDGES.sub("", token)
        low = word.lower()
        out = BASE * (low in LEXICON) | LEARNED * (low in self.lexicon.learned) | PERSON * (low in SECOND_PERSON)
        out |= STEM * any(low[:n] in self.lexicon.stems for n in STEMS if len(low) > n)
        if _ODD.search(low):
            out |= OBFUSCATED
            plain = re.sub(r"[^\w]|_", "", low.translate(LEET))
            known = LEXICON | self.lexicon.learned
            starred = re.escape(low).replace(r"\*", ".")
            if plain in known or "*" in low and any(re.fullmatch(starred, k) for k in known):
                out |= MASKED
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        """(texts, features)."""
        out = np.zeros((len(texts), len(NAMES)))
        memo = self.memo
        for k, text in enumerate(texts):
            tokens = text.split()
            try:
                flags = bytes(map(memo.__getitem__, tokens))
            except KeyError:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                for x in dict.fromkeys(tokens):
                    if x not in memo:
                        memo[x] = self.flags(x)
                flags = bytes(map(memo.__getitem__, tokens))
            n = max(len(tokens), 1)
            f = np.frombuffer(flags, np.uint8)
            base, learned, stem, person, odd, masked = (int(np.count_nonzero(f & b)) for b in (BASE, LEARNED, STEM, PERSON, OBFUSCATED, MASKED))
            bad = np.flatnonzero(f & (BASE | LEARNED | STEM | MASKED))
            near = 0
            if len(bad) and person:
                p = np.flatnonzero(f & PERSON)
                at = np.searchsorted(p, bad)
                near = int(np.count_nonzero(np.minimum(np.abs(bad - p[np.maximum(at - 1, 0)]), np.abs(p[np.minimum(at, len(p) - 1)] - bad)) <= NEAR))
            raw = text.encode("utf-8", "replace")
            caps, small, loud, marks = np.bincount(self.table[np.frombuffer(raw, np.uint8)], minlength=5)[1:5]
            size = max(len(raw), 1)
            out[k] = (
                *(np.log1p(len(tokens)), base, base / n, learned, learned / n, stem, stem / n, masked, masked / n, near, person / n),
                *(caps / max(caps + small, 1), caps > 2 * small, loud / size, marks / size, odd / n, min(len(bad), 3)),
            )
        return out


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = 3, odds: float = 12.0) -> Lexicon:
    """Words and word beginnings that are in least toxic texts or more, and odds times as often there as in others. Toxic texts
    that are mostly a copy of earlier ones aren't counted: their words would seem to be common to many."""
    parts = lambda text: (found := {_EDGES.sub("", w).lower() for w in text.split()}) | {f"{w[:n]}*" for w in found for n in STEMS if len(w) > n}
    toxic, clean, seen = Counter(), Counter(), set()
    for text, y in zip(texts, labels, strict=True):
        if y:
            tokens = text.split()
            runs = {hash(r) for r in zip(tokens, tokens[1:], tokens[2:], strict=False)}
            copied = len(runs & seen) > 0.3 * len(runs)
            seen |= runs
            if not copied:
                toxic.update(parts(text))
    known = {w for w, n in toxic.items() if n >= least}
    for text, y in zip(texts, labels, strict=True):
        if not y:
            clean.update(parts(text) & known)
    ratio = max(np.count_nonzero(labels == 0), 1) / max(np.count_nonzero(labels), 1)
    good = {w for w in known if toxic[w] * ratio >= odds * (clean[w] + 0.5)}
    return Lexicon(frozenset(w for w in good if not w.endswith("*")), frozenset(w[:-1] for w in good if w.endswith("*")))


@dataclass
class Trees:
    """Boosted trees of one depth on binned features: for each tree the feature and bin of its inner nodes, and leaf values."""

    edges: list[np.ndarray]
    start: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(v)))):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with histograms of binned features."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = float(np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3))
    inner = 2**depth - 1
    t = Trees(edges, float(np.log(share / (1 - share))), np.zeros((rounds, inner), np.int64), np.full((rounds, inner), bins + 1), np.zeros((rounds, inner + 1)))
    b, raw = t.bins(x), np.full(len(x), t.start)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for j in range(x.shape[1]):
                slot = (node - first) * (bins + 1) + b[:, j]
                gs = np.bincount(slot, g, n * (bins + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(slot, h, n * (bins + 1)).reshape(n, -1).cumsum(1)
                G, H = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
                gain[(hs < least) | (H - hs < least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = np.flatnonzero(top > best + 1e-9)
                best[better] = top[better]
                t.feature[k, first + better], t.cut[k, first + better] = j, at[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), t.feature[k, node]] > t.cut[k, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        t.value[k] = -rate * gs / (hs + ridge)
        raw += t.value[k, leaf]
    return t


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function that fits y best: neighbouring blocks are pooled until their means rise."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        blocks.append([b * c, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], s, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or self.knots is None:
            return np.where(x[:, NAMES.index("any")] > 0, 0.9, 0.05)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Lexicon, trees and calibration. What a text shows of the learned lexicon, and its score for the calibration, come from
    the other half of the sample, as they would for a new text."""
    if len(set(labels.tolist())) < 2:
        return Model(Lexicon(), None, None)
    half = np.arange(len(texts)) % 2
    x = np.zeros((len(texts), len(NAMES)))
    for k in (0, 1):
        there, here = np.flatnonzero(half != k), np.flatnonzero(half == k)
        x[here] = Featurizer(learn_lexicon([texts[i] for i in there], labels[there])).of([texts[i] for i in here])
    raw = np.zeros(len(texts))
    for k in (0, 1):
        raw[half == k] = boost(x[half != k], labels[half != k], weights[half != k]).raw(x[half == k])
    return Model(learn_lexicon(texts, labels), boost(x, labels, weights), isotonic(raw, labels, weights))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[DataFrame, dict[int, int]]:
    """The bounded sample: mark, text and toxic of at most rows ids of each label, one text an id; and how many ids each label
    has in all. Ids alone are ranked; then the texts of those that were picked are read."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    known = labels.where((fold != held_out) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("mark", F.xxhash64("doc_id"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    # A label's smallest hashes are surely among four times as many that are expected under its share: few rows are ranked.
    low = lambda y: known.where((F.col("toxic") == y) & ((F.col("mark") / F.lit(2.0**64) + 0.5) <= 4 * rows / max(totals.get(y, 0), 1)))
    ids = low(0).orderBy("mark", "doc_id").limit(rows).unionByName(low(1).orderBy("mark", "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= LONG))
    one = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "mark", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(one, "toxicity-sample"), totals


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """Fit on the sample, of each label no more texts once they have so many characters. Weights give the sample the shares of
    all labelled rows."""
    sample, totals = training_rows(docs, labels, rows, folds, held_out)
    texts, toxic, left = [], [], {0: chars, 1: chars}
    for r in sample.orderBy("mark", "doc_id").toLocalIterator():
        if left[r["toxic"]] > 0:
            texts.append(r["text"]), toxic.append(r["toxic"])
            left[r["toxic"]] -= len(r["text"])
    y = np.array(toxic, float)
    each = {k: totals[k] / max(np.count_nonzero(y == k), 1) for k in totals}
    scale = len(y) / max(sum(totals.values()), 1)
    return fit(texts, y, np.array([each[int(k)] for k in y]) * scale)


def score(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text. The model is one broadcast variable of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(shared.value.lexicon)
        for batch in small_batches(batches):
            s = shared.value.score(features.of([t or "" for t in column(batch, "text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(shared.value.lexicon)
        for batch in small_batches(batches):
            s = shared.value.score(features.of([t or "" for t in column(batch, "text").to_pylist()]))
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
