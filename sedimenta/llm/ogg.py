"""Media columns in the Ogg container: 8-bit samples in pages with checksums, packets, logical streams and granules.

A payload is cut into frames of 576 samples. Frames alternate between two logical streams, each frame is one packet,
and packets run over page ends, so that reading back has to check pages, reassemble packets from lacing values, tell
the streams apart and put frames in order by the timestamps that granule positions give.

Null texts count as empty. A payload is never empty: an empty text gives one frame of padding.
Equal texts give equal media whatever row they are in.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import column, materialize, small_batches

FRAME = 576
RATE = 8000
STREAMS = 2
MAGIC = b"SDMPCM8\0"

#: Lacing values in a page; no multiple of the three that a frame takes, so that packets run over page ends.
PAGE_SEGMENTS = 50

CONTINUED, FIRST, LAST = 1, 2, 4
PAGE = struct.Struct("<4sBBqIIIB")
HEAD = struct.Struct("<8sIHHI")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with the plain polynomial, no start value and no last step: zlib's, with the bits of bytes and result turned."""
    turned = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(turned.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = bytearray(PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing)
    struct.pack_into("<I", head, 22, page_checksum(bytes(head) + body))
    return bytes(head) + body


def lacing_values(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def write_ogg(payload: bytes, segments: int = PAGE_SEGMENTS) -> bytes:
    """The payload, a positive multiple of FRAME bytes, as an Ogg file of STREAMS logical streams."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    base = zlib.crc32(payload)
    first, rest = [], []
    for k in range(STREAMS):
        serial, own = base ^ k, frames[k::STREAMS]
        head = HEAD.pack(MAGIC, RATE, k, STREAMS, FRAME)
        first.append(_page(FIRST | (0 if len(own) else LAST), 0, serial, 0, lacing_values(len(head)), head))
        body, lacing = own.tobytes(), lacing_values(FRAME) * len(own)
        per = len(lacing_values(FRAME))
        done = at = 0
        for number, start in enumerate(range(0, len(lacing), segments), 1):
            part = lacing[start : start + segments]
            ended = (start + len(part)) // per
            size = sum(part)
            granule = (k + (ended - 1) * STREAMS + 1) * FRAME if ended > done else -1
            flags = (CONTINUED if start % per else 0) | (LAST if start + segments >= len(lacing) else 0)
            rest.append(((start, k), _page(flags, granule, serial, number, part, body[at : at + size])))
            done, at = ended, at + size
    return b"".join(first + [p for _, p in sorted(rest, key=lambda x: x[0])])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """flags, granule, serial, number, lacing and body of each page; a wrong checksum or capture pattern is an error."""
    at = 0
    while at < len(media):
        magic, version, flags, granule, serial, number, checksum, n = PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        if end > len(media):
            raise ValueError(f"the page at byte {at} is cut off")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        yield flags, granule, serial, number, lacing, media[at + PAGE.size + n : end]
        at = end


def demultiplex(media: bytes) -> tuple[dict[int, list[tuple[int, bytes]]], int]:
    """By serial number the packets with the granule position at which each ends, -1 where none follows from its page; pages."""
    streams: dict[int, dict] = {}
    pages = 0
    for flags, granule, serial, number, lacing, body in read_pages(media):
        pages += 1
        if flags & FIRST:
            streams[serial] = {"next": 0, "open": [], "packets": [], "step": 0}
        s = streams[serial]
        if number != s["next"] or bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError(f"a page of stream {serial} is missing before its page {number}")
        s["next"] += 1
        ended, at, size = [], 0, 0
        for v in lacing:
            size += v
            if v < 255:
                ended.append(b"".join([*s["open"], body[at : at + size]]))
                s["open"], at, size = [], at + size, 0
        if size:
            s["open"].append(body[at:])
        if flags & FIRST:
            magic, _, _, n, frame = HEAD.unpack(ended[0])
            if magic != MAGIC:
                raise ValueError("unknown codec")
            s["step"] = n * frame
            continue
        back = [granule - s["step"] * i for i in range(len(ended))][::-1]
        s["packets"] += zip(back, ended, strict=True)
    if any(s["open"] for s in streams.values()):
        raise ValueError("the last packet is cut off")
    return {k: s["packets"] for k, s in streams.items()}, pages


def read_ogg(media: bytes) -> tuple[bytes, dict]:
    """The payload, with frames of all streams in order of time, and figures of the container."""
    streams, pages = demultiplex(media)
    packets = sorted(p for s in streams.values() for p in s)
    if [g for g, _ in packets] != [FRAME * (i + 1) for i in range(len(packets))]:
        raise ValueError("frames are missing or their times overlap")
    return b"".join(p for _, p in packets), {"streams": len(streams), "pages": pages, "packets": len(packets), "end_us": packets[-1][0] * 1_000_000 // RATE}


def sample_features(payload: bytes, container: dict) -> str:
    """What the samples show, as text of whole numbers: length in time, level, energy, crossings of the middle, peaks."""
    a = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    wide = a.astype(np.int64)
    above = a >= 0
    return ";".join(
        f"{k}={v}"
        for k, v in (
            *container.items(),
            ("sum", int(wide.sum())),
            ("energy", int(np.dot(wide, wide))),
            ("crossings", int(np.count_nonzero(above[1:] != above[:-1]))),
            ("low", int(a.min())),
            ("high", int(a.max())),
        )
    )


def padded(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % FRAME if text else FRAME)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text in UTF-8, padded with bytes 255, as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [(x or "").encode() for x in column(batch, "text").to_pylist()]
            media = [write_ogg(padded(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and figures of every stored file; a damaged one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            got = [read_ogg(x) for x in column(batch, "media").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array([p for p, _ in got], pa.binary()), pa.array([sample_features(*x) for x in got])], ["doc_id", "n_bytes", "payload", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload binary, feature string")


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as media, read the stored files back and give their digests and features."""
    stored = materialize(encode_media(docs), "ogg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            media = column(batch, "media").to_pylist()
            got = [read_ogg(x) for x in media]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    column(batch, "n_bytes"),
                    pa.array([len(p) for p, _ in got], pa.int64()),
                    pa.array([sha(p) for p, _ in got]),
                    pa.array([zlib.crc32(p[-32:]) for p, _ in got], pa.int64()),
                    pa.array(map(len, media), pa.int64()),
                    pa.array(map(sha, media), pa.string()),
                    pa.array([sample_features(*x) for x in got]),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", F.col("media")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
