"""Language identification by unigram models of pieces, summed over all segmentations.

The vocabulary is fixed and public; each language has a probability for every piece. A word is scored by the forward
algorithm: the sum over all ways to cut it into pieces of the product of their probabilities. Words may have any length:
they are gone through in blocks of letters, and the sums are scaled as they go. Pieces never reach over what is no letter,
so the score of a text is the sum over its words, and words are scored once for a bounded memo.

The models are fitted by expectation maximisation on a bounded sample of the labelled rows outside the held-out fold: of
each of the max_languages most frequent languages at most sample_rows distinct texts, those with the smallest hash, and
no more once they have sample_chars characters. Long texts come last, so a language that has only such is learned from
one of them. Everything else covers all rows and whole texts. Repeated rows count once in the sample and are scored alike.

A text that is null or has no letter gets und and score 0. Without any labelled row every text gets und. doc_id may have
any type; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import column, small_batches

UNKNOWN = "und"

#: The sample: texts and characters of a language, characters from which a text counts as long, and languages. A model of so
#: many languages takes about 65 MB.
SAMPLE_ROWS, SAMPLE_CHARS, LONG, MAX_LANGUAGES = 400, 4_000_000, 50_000, 512
FOLDS, HELD_OUT = 5, 0
ROUNDS = 3

#: Letters of a word that are gone through at once, and numbers (words times letters times languages) held at once.
BLOCK, CELLS = 256, 1 << 20

#: Letters over which a sum may fall before it is scaled, counted with the longest piece: FLOOR to that power is a normal number.
REACH = 42

#: Least probability of a piece, and that of a letter that is no piece.
FLOOR = 1e-7

#: What every piece has been seen beforehand, in occurrences.
PRIOR = 0.05
MEMO_WORDS = 300_000

WORDS = re.compile(r"[^\W\d_]+")


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """Pieces of letters, in lower case, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in pieces if WORDS.fullmatch(p.removeprefix("▁"))})


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Trie:
    """The pieces as a tree whose edges are one sorted array, so that many words step down it at once."""

    def __init__(self, pieces: list[str]):
        nodes: dict[tuple[int, str], int] = {}
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        ends = {}
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = nodes.setdefault((node, c), len(nodes) + 1)
            ends[node] = k
        keys = np.array([n << 21 | ord(c) for n, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())

    def step(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have an edge of that character, and where the edges of those lead."""
        if not len(self.keys):
            return np.zeros(len(node), bool), node[:0]
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return found, self.child[at[found]]


def edges(words: list[str], sizes: np.ndarray, trie: Trie, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """word, start, end and piece of every piece in words that ends behind lo and not behind hi, by end and then word. Words have
    a mark of their start in front; a letter that is no piece is one of an unknown kind."""
    first = max(0, lo + 1 - trie.longest)
    chars = np.frombuffer("".join(f"▁{w}"[first:hi].ljust(hi - first, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
    word, start = np.nonzero(np.arange(first, hi) < sizes[:, None])
    start += first
    node, stop = np.zeros(len(word), np.int64), np.minimum(sizes, hi)
    parts: list[tuple[np.ndarray, ...]] = []
    for n in range(trie.longest):
        found, node = trie.step(node, chars[word, start + n - first])
        if n == 0:
            piece = np.full(len(word), trie.unknown)
            piece[found] = np.where(trie.piece[node] >= 0, trie.piece[node], trie.unknown)
            parts.append((word, start, piece, start + 1))
            word, start = word[found], start[found]
        else:
            word, start = word[found], start[found]
            full = trie.piece[node] >= 0
            parts.append((word[full], start[full], trie.piece[node[full]], start[full] + n + 1))
        on = start + n + 1 < stop[word]
        word, start, node = word[on], start[on], node[on]
        if not len(word):
            break
    word, start, piece, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = np.flatnonzero(end > lo)
    keep = keep[np.lexsort((word[keep], end[keep]))]
    return word[keep], start[keep], end[keep], piece[keep]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(keys[0]) else np.empty(0, np.int64)


class Lattice:
    """All pieces inside each of some words, for fitting: sums over segmentations as logarithms."""

    def __init__(self, words: list[str], trie: Trie):
        self.last = np.array([len(w) + 1 for w in words], np.int64)
        self.length = int(self.last.max(initial=0))
        self.word, self.start, self.end, self.piece = edges(words, self.last, trie, 0, self.length)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(words, letters + 1, languages): of each beginning of each word."""
        a = np.full((len(self.last), self.length + 1, p.shape[1]), -np.inf)
        a[:, 0] = 0
        weight = np.log(p)
        cuts = np.searchsorted(self.end, np.arange(1, self.length + 2))
        for j in range(1, self.length + 1):
            e = slice(cuts[j - 1], cuts[j])
            word = self.word[e]
            if len(word):
                h = _runs(word)
                a[word[h], j] = np.logaddexp.reduceat(a[word, self.start[e]] + weight[self.piece[e]], h)
        return a

    def backward(self, p: np.ndarray) -> np.ndarray:
        """The same of each ending."""
        b = np.full((len(self.last), self.length + 1, p.shape[1]), -np.inf)
        b[np.arange(len(self.last)), self.last] = 0
        weight = np.log(p)
        order = np.lexsort((self.word, self.start))
        cuts = np.searchsorted(self.start[order], np.arange(self.length + 1))
        for i in range(self.length - 1, -1, -1):
            e = order[cuts[i] : cuts[i + 1]]
            word = self.word[e]
            if len(word):
                h = _runs(word)
                b[word[h], i] = np.logaddexp.reduceat(b[word, self.end[e]] + weight[self.piece[e]], h)
        return b

    def totals(self, p: np.ndarray) -> np.ndarray:
        """(words, languages): logarithms of the sums over all segmentations."""
        return self.forward(p)[np.arange(len(self.last)), self.last]


def log_totals(words: list[str], trie: Trie, p: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The same as Lattice.totals(), for scoring: block by block, so that a word of any length needs the memory of a block. Sums
    are plain numbers, and what may fall too low is divided by the sum at hand, whose logarithm is kept."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    n, k, back = len(words), p.shape[1], trie.longest
    if back >= REACH:
        raise ValueError(f"a piece has {back} letters; scaling allows for fewer than {REACH}")
    out, logs, live, a = np.zeros((n, k)), np.zeros((n, k)), np.arange(n), None
    for lo in range(0, int(sizes.max(initial=0)), block):
        hi = min(lo + block, int(sizes.max()))
        kept = np.zeros((len(live), back + hi - lo, k))  # of places lo + 1 - back to hi
        if a is None:
            kept[:, back - 1] = 1
        else:
            kept[:, :back] = a
        a = kept
        word, start, end, piece = edges([words[i] for i in live], sizes[live], trie, lo, hi)
        weight = p[piece].astype(float)
        at = start - (lo + 1 - back)
        heads = _runs(word, end)
        cuts, runs = np.searchsorted(end, np.arange(lo + 1, hi + 2)), np.searchsorted(end[heads], np.arange(lo + 1, hi + 2))
        for j in range(lo + 1, hi + 1):
            x, y = cuts[j - lo - 1], cuts[j - lo]
            h = heads[runs[j - lo - 1] : runs[j - lo]]
            if not len(h):
                break
            now = j - lo - 1 + back
            a[word[h], now] = np.add.reduceat(a[word[x:y], at[x:y]] * weight[x:y], h - x)
            if j % (REACH - back) == 0:
                on = np.flatnonzero(sizes[live] > j)
                scale = a[on, now]
                logs[live[on]] += np.log(scale)
                a[on, now + 1 - back : now + 1] /= scale[:, None]
        ends = np.flatnonzero(sizes[live] <= hi)
        out[live[ends]] = np.log(a[ends, sizes[live[ends]] - (lo + 1 - back)]) + logs[live[ends]]
        on = np.flatnonzero(sizes[live] > hi)
        live, a = live[on], a[on, hi - lo :]
    return out


def batches_of(words: list[str], cells: int) -> Iterator[list[int]]:
    """Places of words, the shortest first, in batches of at most so many letters, each word filled up to the longest."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    part: list[int] = []
    for i in order:
        if part and (len(part) + 1) * (min(len(words[i]), BLOCK) + 1) > cells:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece (the last row: of a letter that is none) in each."""
    langs, trie, unknown = sorted(counts), Trie(pieces), len(pieces)
    table = np.full((unknown + 1, len(langs)), FLOOR, np.float32)
    for k, lang in enumerate(langs):
        words = list(counts[lang])
        times = np.array([counts[lang][w] for w in words], float)
        p = np.full((unknown + 1, 1), 1e-4)
        p[-1] = FLOOR
        lattices = [(Lattice([words[i] for i in part], trie), times[part]) for part in batches_of(words, CELLS // 4)]
        for _ in range(rounds):
            seen = np.full(unknown + 1, PRIOR)
            for x, n in lattices:
                a, b = x.forward(p)[:, :, 0], x.backward(p)[:, :, 0]
                share = np.exp(a[x.word, x.start] + np.log(p[x.piece, 0]) + b[x.word, x.end] - a[np.arange(len(x.last)), x.last][x.word]) * n[x.word]
                seen += np.bincount(x.piece, share, len(seen))
            p = np.maximum(seen / seen.sum(), FLOOR)[:, None]
            p[-1] = FLOOR
        table[:, k] = p[:, 0]
    return langs, table


class Scorer:
    """Scores of whole texts in every language; made once in each Python worker."""

    def __init__(self, pieces: list[str], langs: list[str], table: np.ndarray, memo_words: int = MEMO_WORDS):
        self.trie, self.langs, self.table, self.memo_words = Trie(pieces), langs, table, memo_words
        self.memo: dict[str, int] = {}
        self.scores = np.empty((0, len(langs)))

    def _learn(self, words: list[str]) -> None:
        if len(self.memo) + len(words) > self.memo_words:
            self.memo, self.scores = {}, np.empty((0, len(self.langs)))
        out = np.zeros((len(words), len(self.langs)))
        for part in batches_of(words, max(CELLS // max(len(self.langs), 1), 1 << 12)):
            out[part] = log_totals([words[i] for i in part], self.trie, self.table)
        at = len(self.scores)
        self.memo.update((w, at + k) for k, w in enumerate(words))
        self.scores = np.concatenate([self.scores, out])

    def of_batch(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text the log-likelihood in each language; None where it has no word."""
        each = [words_of(t) if t else [] for t in texts]
        new = dict.fromkeys(w for ws in each for w in ws if w not in self.memo)
        if len(self.memo) + len(new) > self.memo_words:
            new = dict.fromkeys(w for ws in each for w in ws)
        if new:
            self._learn(list(new))
        get = self.memo.__getitem__
        return [self.scores[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0) if ws else None for ws in each]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for s in self.of_batch(texts):
            if s is None or not self.langs:
                langs.append(UNKNOWN), scores.append(0.0)
                continue
            k = int(np.argmax(s))
            langs.append(self.langs[k])
            scores.append(float(1 / np.exp(np.minimum(s - s[k], 0)).sum()))
        return langs, scores


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, languages: int = MAX_LANGUAGES, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """The bounded sample that models are fitted on: lang, text. Hashes of id and text are ranked alone; then the texts of at
    most rows * languages hashes are read, one of each."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    able = docs.where((fold != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    able = able.select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("mark"))
    top = able.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("mark").alias("marks")).orderBy(F.col("n").desc(), "lang").limit(languages)
    top = top.select("lang", (4 * rows / F.col("marks")).alias("share"))
    # A language's smallest hashes are surely among four times as many that are expected under its share: few are ranked.
    low = able.join(F.broadcast(top), "lang").where((F.col("mark") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.col("size") > LONG, "mark")
    ranked = low.select("lang", "mark", F.length("text").cast("bigint").alias("size")).distinct().select("lang", "mark", F.row_number().over(order).alias("rank"), (F.sum("size").over(order) - F.col("size")).alias("before"))
    picked = ranked.where((F.col("rank") <= rows) & (F.col("before") < chars)).select("lang", "mark")
    return able.join(F.broadcast(picked), ["lang", "mark"]).groupBy("lang", "mark").agg(F.first("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, vocabulary_path: str | None = None, **sample: int) -> tuple[list[str], list[str], np.ndarray]:
    """Vocabulary, languages and probabilities, from the labelled rows outside the held-out fold."""
    pieces = vocabulary(vocabulary_path or default_vocabulary_path())
    counts: dict[str, Counter] = {}
    for row in training_rows(docs, **sample).toLocalIterator():
        counts.setdefault(row["lang"], Counter()).update(words_of(row["text"]))
    langs, table = fit(counts, pieces)
    return pieces, langs, table


def identify(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text. The model is one broadcast variable: its size is that of
    the vocabulary times the languages, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, table = shared.value
        scorer = Scorer(pieces, langs, table)
        for batch in small_batches(batches):
            lang, score = scorer.predict(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
