"""Byte-level BPE by forced-boundary splitting.

A cut between two bytes is certain where the pair occurs inside no token of the vocabulary: no merge can ever span it. So
inside the pieces that the pre-tokenizer gives, a text is cut at every such pair, and the fragments are merged
independently, by the ranks alone, each distinct one once per bounded memo; their ids are concatenated.

Texts come to the pre-tokenizer in stretches, mostly a word with the space before it, each distinct one once per bounded
memo. They are cut where, besides, the right byte is white space of ASCII and the left character is none: the
pre-tokenizer looks ahead at white space only, so there its pattern always ends a piece, and what follows is split alike
with or without what stood before. Stretches with a special token go through the library whole.

Null texts count as empty and give no ids. Ties, repeated rows and extra columns change nothing: each row is
encoded by itself. Texts are encoded whole, however long.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import column, small_batches, trim

#: Distinct stretches, and as many fragments, that a worker remembers before it starts anew.
MEMO_FRAGMENTS = 120_000

#: Longer ones are encoded but not remembered.
MEMO_LENGTH = 64

#: Bytes of texts that are encoded at once.
TEXT_BYTES = 1 << 19

BLANK = "\t\n\v\f\r "

#: The pattern of byte-level pre-tokenizers, a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters whose class every Unicode table agrees on.
COMMON = re.compile("[\n\t -~\xa1-\u024f]*")

#: White space that is not in BLANK, and what of it is ASCII.
ODD_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD_ASCII = re.compile("[\x1c-\x1f]")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCodec:
    """Encoder and decoder over one vocabulary file; made once in each Python worker."""

    def __init__(self, path: str, memo_fragments: int = MEMO_FRAGMENTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        size = max([*spec["model"]["vocab"].values(), *added]) + 1
        self.token_bytes = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token) if i not in added else b""
        inside = np.zeros((256, 256), bool)
        for token in self.token_bytes:
            a = np.frombuffer(token, np.uint8)
            inside[a[:-1], a[1:]] = True
        for i, content in added.items():
            a = np.frombuffer(content.encode(), np.uint8)
            inside[a[:-1], a[1:]] = True
            self.token_bytes[i] = content.encode()
        self.inside = inside
        self.byte_of = np.zeros(1 << 16, np.uint8)
        self.byte_of[[ord(c) for c in alphabet]] = list(alphabet.values())
        self.letter_of = {b: c for c, b in alphabet.items()}
        self.quick, self.slow = self._patterns()
        self.has_special = re.compile("|".join(map(re.escape, added.values())) or "(?!)").search
        usual = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec.get("normalizer")
        self.pattern = regex.compile(PIECES) if usual else None
        self.memo: dict[str, bytes] = {}
        self.merged: dict[bytes, bytes] = {}
        self.memo_fragments = memo_fragments
        self.forced = 0  # cuts that were made inside pieces

    def certain_cuts(self) -> list[tuple[int, int]]:
        """Byte pairs at which a text may be cut before the pre-tokenizer: in no token, white space of ASCII on the right, none on
        the left."""
        blank = BLANK.encode()
        return [(a, b) for b in blank for a in range(256) if a not in blank and not self.inside[a, b]]

    def _patterns(self) -> tuple[re.Pattern | None, re.Pattern]:
        """What finds the stretches. The first is quick: it cuts before each run of blanks, and holds where a blank follows no
        whole character inside a token but white space beyond ASCII, and the text has none of that; the second tests each
        place by its bytes."""
        cuts = self.certain_cuts()
        pairs = {(a, b) for b in BLANK.encode() for a in range(256) if a not in BLANK.encode()} - {*cuts}
        whole = [t.decode("utf-8", "ignore") for t in self.token_bytes if any((a, b) in pairs for a, b in zip(t, t[1:], strict=False))]
        odd = all(ODD_BLANK.fullmatch(x) or y not in BLANK or x in BLANK for t in whole for x, y in zip(t, t[1:], strict=False))
        quick = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+") if odd else None
        parts = []
        for right in sorted({b for _, b in cuts}):
            left = {a for a, b in cuts if b == right}
            ascii_left = "".join(re.escape(chr(a)) for a in range(128) if a in left)
            wide = left >= set(range(128, 192))  # the last byte of a longer character is one of these
            if ascii_left or wide:
                parts.append(f"(?<=[{ascii_left}{chr(128) + '-' + chr(0x10FFFF) if wide else ''}])(?<!\\s)(?={re.escape(chr(right))})")
        return quick, re.compile("|".join(parts) or "(?!)")

    def stretches(self, text: str) -> list[str]:
        """The text cut where the pre-tokenizer always does and no token reaches over."""
        if self.quick is not None and (text.isascii() and not ODD_ASCII.search(text) or not ODD_BLANK.search(text)):
            return self.quick.findall(text)
        return self.slow.split(text) if text else []

    def split(self, texts: list[str]) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts, and where the pieces that the pre-tokenizer makes of each end."""
        if self.pattern is not None and (row := "".join(texts)) and COMMON.fullmatch(row) and all(x[0] in BLANK and not x[-1].isspace() for x in texts):
            # Stretches that begin with a blank and don't end with one stay apart in a row, so the pattern splits them at once.
            ends = np.cumsum(np.fromiter(map(len, self.pattern.findall(row)), np.int64))
            raw = row.encode()
            if len(raw) > len(row):
                firsts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                ends = np.append(firsts, len(raw))[ends]
            return raw, ends
        pieces = [p for x in texts for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        letters = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)
        return self.byte_of[letters].tobytes(), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def fragments(self, raw: bytes, ends: np.ndarray) -> np.ndarray:
        """Where pieces that end there are to be cut: at their ends, and inside at every pair of bytes that is in no token."""
        data = np.frombuffer(raw, np.uint8)
        cut = np.append(~self.inside[data[:-1], data[1:]], False)
        cut[ends - 1] = False
        self.forced += int(np.count_nonzero(cut))
        cut[ends - 1] = True
        return np.flatnonzero(cut) + 1

    def merge(self, fragment: bytes) -> bytes:
        """The ids of a fragment, by the ranks of its merges alone."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(fragment.decode("latin-1").translate(self.letter_of))]).tobytes()

    def _learn(self, missing: list[str]) -> None:
        memo, merged = self.memo, self.merged
        special = [x for x in missing if self.has_special(x)]
        for text, enc in zip(special, self.tokenizer.encode_batch_fast(special, add_special_tokens=False) if special else [], strict=True):
            memo[text] = array("I", enc.ids).tobytes()
        plain = [x for x in missing if x not in memo]
        row = [x for x in plain if x[0] in BLANK and not x[-1].isspace() and COMMON.fullmatch(x)]
        in_row = {*row}
        for texts in (row, [x for x in plain if x not in in_row]):
            if not texts:
                continue
            raw, ends = self.split(texts)
            at = self.fragments(raw, ends)
            stops = at.tolist()
            found = [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            if len(merged) > self.memo_fragments:
                merged.clear()
            for x in {*found}:
                if x not in merged:
                    merged[x] = self.merge(x)
            ids = list(map(merged.__getitem__, found))
            for x in {x for x in found if len(x) > MEMO_LENGTH}:
                del merged[x]
            every, offsets = b"".join(ids), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            sizes = np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in texts), np.int64, len(texts))
            to = offsets[np.searchsorted(at, np.cumsum(sizes))].tolist()
            memo.update(zip(texts, (every[a:b] for a, b in zip([0, *to], to, strict=False)), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, as the library gives for the whole text."""
        memo = self.memo
        if len(memo) > self.memo_fragments:
            memo.clear()
        steps = [self.stretches(x) for x in texts]
        missing = list({x for step in steps for x in step if x not in memo})
        if missing:
            self._learn(missing)
        out = [b"".join(map(memo.__getitem__, step)) for step in steps]
        for x in missing:
            if len(x) > MEMO_LENGTH:
                del memo[x]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 bytes of the text that the library's decode() gives, special tokens kept."""
        table = self.token_bytes
        out = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode("utf-8", "replace").encode()


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


@contextlib.contextmanager
def at_work(path: str) -> Iterator[ForcedBoundaryCodec]:
    """A codec for a task. What it remembers goes when the task ends: the worker lives on and may be needed for other work."""
    c = codec(path)
    try:
        yield c
    finally:
        c.memo.clear()
        c.merged.clear()
        trim()


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with at_work(path) as c:
            for batch in small_batches(batches, limit=TEXT_BYTES):
                ids = c.encode_batch([x or "" for x in column(batch, "text").to_pylist()])
                yield pa.RecordBatch.from_arrays([column(batch, "row_key"), pa.array(ids, pa.binary())], ["row_key", "ids"])

    return run


def encode_texts(docs: DataFrame, key: str = "doc_id", tokenizer_path: str | None = None) -> DataFrame:
    """row_key and ids (binary: little-endian unsigned 32-bit integers) of each row's whole text; null: no ids."""
    path = tokenizer_path or default_tokenizer_path()
    return docs.select(F.col(key).alias("row_key"), "text").mapInArrow(_encoder(path), f"row_key {docs.schema[key].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """row_key and the text that each row's ids stand for; null ids: null."""
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in small_batches(batches, "ids"):
            texts = [None if x is None else c.decode(x).decode() for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "row_key"), pa.array(texts, pa.string())], ["row_key", "text"])

    return encoded.select("row_key", "ids").mapInArrow(run, f"row_key {encoded.schema['row_key'].dataType.simpleString()}, text string")


def encode_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Encode each whole text, decode the ids again, and give doc_id, n_tokens and the digests of both.

    A null text is empty. Each row gives one row, repeated doc_ids included.
    """
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        with at_work(path) as c:
            for batch in small_batches(batches, limit=TEXT_BYTES):
                ids = c.encode_batch([x or "" for x in column(batch, "text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array((sha(c.decode(x)) for x in ids), pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
