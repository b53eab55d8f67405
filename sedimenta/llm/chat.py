"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is a header line with its role, a start mark, the text, an end mark and a line
that ends the turn. Control strings inside roles and texts are escaped, reversibly. The rendered text is encoded with
offsets, and the tokens under the loss mask are found by intersecting the sorted spans of assistant texts with the spans
of tokens by binary search. The marks are the control characters START and STOP: no token of the vocabulary goes on behind
the one or begins before the other, so no token reaches over an edge of a text, and the mask covers the texts and nothing
else. A vocabulary for which that doesn't hold is refused.

Turns are ordered by turn, then role, then text, so ties and repeated rows have one order; nulls come first. A null text
or role counts as empty, a null conv_id is a conversation of its own. Turns are dealt by ranges of that order, so one
conversation that holds many of them is formatted by many tasks, in segments of whole turns, and needs no more memory than
a segment. The cut between two turns lies between a line end and a header mark, where the pre-tokenizer always ends a
piece: segments give the ids of the whole. Texts of any length are encoded whole. Columns besides conv_id, turn, role and
text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.bpe import ForcedBoundaryCodec, codec, default_tokenizer_path
from sedimenta.llm.common import column, materialize

HEADER, START, STOP = "### ", "\x02", "\x03"
END = f"{STOP}\n</turn>\n"
LOSS_ROLE = "assistant"

#: Characters of rendered text after which a segment of a long conversation ends.
SEGMENT_CHARS = 1 << 18

_CONTROL = re.compile(r"\\|(?<=#)#|(?<=<)[/|]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"### ([^\\n]*)\\n{START}(.*?){END}", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each backslash, before each # after a #, and before / or | after <."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text of (role, text) turns, and the sorted spans of what the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEADER}{escape_role(role)}\n{START}", escape(text)
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def loss_mask(token_starts: np.ndarray, token_ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens inside a span. Both are sorted; the first span that ends behind a token's start decides. A token that
    reaches over an edge of a span is an error."""
    if not len(spans):
        return np.zeros(len(token_starts), bool)
    k = np.searchsorted(spans[:, 1], token_starts, side="right")
    first, last = (np.append(spans[:, x], np.iinfo(np.int64).max)[k] for x in (0, 1))
    mask = first < token_ends
    if np.any(mask & ((token_starts < first) | (token_ends > last))):
        raise ValueError("a token reaches over an edge of what the loss covers")
    return mask


def masked_spans(token_starts: np.ndarray, token_ends: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The sorted character spans that runs of masked tokens cover; several tokens may share a character."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return np.stack([token_starts[first], token_ends[last]], 1).astype(np.int64)


def checked_codec(path: str) -> ForcedBoundaryCodec:
    c = codec(path)
    if c.inside[ord(START)].any() or c.inside[:, ord(STOP)].any():
        raise ValueError(f"{path} has tokens that go on behind a start mark or begin before an end mark")
    return c


def _segments(turns: Iterator[tuple[str, str]], limit: int) -> Iterator[list[tuple[str, str]]]:
    part, size = [], 0
    for turn in turns:
        part.append(turn)
        size += len(turn[1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


SEGMENT = "segment bigint, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"


def format_conversations(conversations: DataFrame, tokenizer_path: str | None = None, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row for each segment of whole turns: conv_id, segment (a number that rises with the turns), formatted text, token ids
    with their spans, and the loss mask."""
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, first = checked_codec(path), TaskContext.get().partitionId() << 32
        rows = ((i, r or "", t or "") for b in batches for i, r, t in zip(*(column(b, x).to_pylist() for x in ("conv_id", "role", "text")), strict=True))
        for conv, turns in groupby(rows, key=lambda x: x[0]):
            for n, part in enumerate(_segments(((r, t) for _, r, t in turns), segment_chars)):
                formatted, spans = render(part)
                enc = c.tokenizer.encode(formatted, add_special_tokens=False)
                offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
                mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
                values = [conv], [first + n], [formatted], [enc.ids], [offsets[:, 0]], [offsets[:, 1]], [mask]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    ints = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int64(), pa.string(), ints, ints, ints, pa.list_(pa.bool_())]
    names = ["conv_id", *(x.split()[0] for x in SEGMENT.split(", "))]
    order = ["conv_id", "turn", "role", "text"]
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id bigint, {SEGMENT}")


#: Bytes that are digested at once.
PART_BYTES = 1 << 20

PARTS = "conv_id bigint, segment bigint, part bigint, turns bigint, chars bigint, loss_chars bigint, said binary, loss binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a formatted segment says, in parts: the turns from its text, the loss from its mask and offsets alone."""
    names, kinds = zip(*(x.split() for x in PARTS.split(", ")), strict=True)
    kinds = [{"bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    for batch in batches:
        for conv, segment, text, starts, ends, mask in zip(*(column(batch, x).to_pylist() for x in ("conv_id", "segment", "formatted", "token_starts", "token_ends", "loss")), strict=True):
            turns = parse(text)
            under = masked_spans(np.array(starts, np.int64), np.array(ends, np.int64), np.array(mask, bool))
            loss = "".join(unescape(text[s:e]) for s, e in under.tolist())
            said, lost = "".join(f"{r}\n{t}\n" for r, t in turns).encode(), loss.encode()
            for n, at in enumerate(range(0, max(len(said), len(lost), 1), PART_BYTES)):
                values = conv, segment, n, len(turns) * (n == 0), len(text) * (n == 0), len(loss) * (n == 0), said[at : at + PART_BYTES], lost[at : at + PART_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [*names])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation: turns and what the loss mask covers, taken from the formatted output alone. A digest over
    a whole conversation is taken in order, so its parts, bytes of texts without tokens, stream through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turns", "chars", "loss_chars", "said", "loss"]
        rows = (r for b in batches for r in zip(*(column(b, x).to_pylist() for x in names), strict=True))
        for conv, parts in groupby(rows, key=lambda x: x[0]):
            turns = loss_chars = chars = 0
            all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
            for _, n, size, under, said, loss in parts:
                turns, chars, loss_chars = turns + n, chars + size, loss_chars + under
                all_turns.update(said), all_loss.update(loss)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in ((conv, pa.int64()), (turns, pa.int64()), (all_turns.hexdigest(), pa.string()), (loss_chars, pa.int64()), (all_loss.hexdigest(), pa.string()), (chars, pa.int64()))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    parts = formatted.select("conv_id", "segment", "formatted", "token_starts", "token_ends", "loss").mapInArrow(_parsed, PARTS)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def format_digests(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Format every conversation, store the output, and give the digests of what is read back from it."""
    return read_back(materialize(format_conversations(conversations, tokenizer_path), "chat"))
