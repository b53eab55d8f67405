"""WARC archives with revisit resolution.

Records are written as members of gzip, many to a chunk. An archive is a table of chunks (archive, chunk, data): the
chunks of an archive in order, joined, are a .warc.gz file. As a table they are written by Spark's own committer into
any store it knows, so a task that is lost and run again leaves no half archive; export_archives() puts out files.

To deduplicate, the headers alone are shuffled by payload digest; for each digest the record with the smallest page_id
is the original. Records join the originals by digest and get fresh headers: response with the payload, or revisit
with references to the original and no payload. Digests of many records are hot keys: those over a share of all records,
of which there are few whatever the input, join by broadcast, the rest by shuffle.

A null html is an empty payload. Null page_ids come after all others; equal ones are told apart by their place. A
payload shorter than min_bytes is never a revisit. Payloads of any length are written whole, one record at a time. A url
is read back as it was. Columns besides page_id, url and html are ignored. An empty table gives empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import column, materialize, small_batches

CRAWL_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records before compression after which a chunk ends.
CHUNK_BYTES = 4 << 20

#: A digest with more than this share of all records is hot; at most the inverse of it, 1000 digests, can be.
HOT_SHARE = 0.001

LEVEL = 5

#: Bytes that are decompressed at once.
READ = 1 << 13


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a member of gzip; the time in gzip's header is 0, so equal records are equal bytes."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a chunk or a whole archive, whose bytes are gone through once."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("a record is cut off")
            part = view[at : at + READ]
            parts.append(z.decompress(part))
            at += len(part)
        at -= len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("wrong length of a record")
        yield headers, rest[:size]


def uri_headers(url: str | None) -> list[tuple[str, str | None]]:
    """A url that has line ends or blanks at its ends, which a header can't carry, stands cleaned in its usual place and as it is,
    in base64, in a header of its own."""
    if url is None:
        return []
    clean = url.replace("\r", "%0D").replace("\n", "%0A").strip()
    return [("WARC-Target-URI", clean)] + ([("X-Target-URI", base64.b64encode(url.encode()).decode())] if clean != url else [])


def uri_of(headers: dict[str, str]) -> str | None:
    raw = headers.get("X-Target-URI")
    return headers.get("WARC-Target-URI") if raw is None else base64.b64decode(raw).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


CHUNKS = "archive string, chunk bigint, data binary"


def _chunk(archive: str, n: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n], pa.int64()), pa.array([b"".join(data)], pa.binary())], ["archive", "chunk", "data"])


def _chunks(records: Iterator[tuple[bytes, int]], archive: str) -> Iterator[pa.RecordBatch]:
    n, part, held = 0, [], 0
    for record, size in records:
        part.append(record)
        held += size
        if held >= CHUNK_BYTES:
            yield _chunk(archive, n, part)
            n, part, held = n + 1, [], 0
    if part:
        yield _chunk(archive, n, part)


def write_archives(pages: DataFrame, date: str = CRAWL_DATE) -> DataFrame:
    """Every row as a response record with its digests, an archive for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive = f"crawl-{TaskContext.get().partitionId():06d}"

        def records() -> Iterator[tuple[bytes, int]]:
            n = 0
            for b in small_batches(batches, "html"):
                for page, url, html in zip(column(b, "page_id").to_pylist(), column(b, "url").to_pylist(), column(b, "html").to_pylist(), strict=True):
                    payload = (html or "").encode()
                    block = http_block(payload)
                    record = write_record(
                        [
                            ("WARC-Type", "response"),
                            ("WARC-Record-ID", _record_id(archive, n, page)),
                            ("WARC-Date", date),
                            *uri_headers(url),
                            ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
                            ("Content-Type", "application/http;msgtype=response"),
                            ("X-Page-Id", None if page is None else str(page)),
                            ("X-Payload-Length", str(len(payload))),
                        ],
                        block,
                    )
                    yield record, len(block)
                    n += 1

        yield from _chunks(records(), archive)

    return pages.select("page_id", "url", "html").mapInArrow(run, CHUNKS)


HEADERS = "archive string, chunk bigint, place bigint, page_id bigint, uri string, record_id string, date string, digest string, payload_bytes bigint"


def read_headers(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives, without its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, chunk, data in zip(*(column(batch, x).to_pylist() for x in ("archive", "chunk", "data")), strict=True):
                rows = []
                for place, (h, _) in enumerate(read_records(data)):
                    page = h.get("X-Page-Id")
                    rows.append((archive, chunk, place, None if page is None else int(page), uri_of(h), h["WARC-Record-ID"], h["WARC-Date"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in HEADERS.split(", ")])

    return archives.mapInArrow(run, HEADERS)


def resolve_revisits(headers: DataFrame, min_bytes: int = 0, hot_share: float = HOT_SHARE) -> DataFrame:
    """The headers with the original of each: columns original (page_id, uri, record_id, date), null where a record stays
    a response. Digests are compared together with lengths."""
    order = F.struct(F.col("page_id").isNull().alias("no_page"), "page_id", "archive", "chunk", "place", "uri", "record_id", "date")
    long = headers.where(F.col("payload_bytes") >= min_bytes)
    firsts = long.groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts, "warc-firsts")
    total = headers.count()
    hot = firsts.where(F.col("n") > hot_share * total)
    key = ["digest", "payload_bytes"]
    warm = headers.join(F.broadcast(hot.select(*key, F.col("first").alias("hot"))), key, "left")
    of_hot = warm.where("hot is not null").withColumnRenamed("hot", "first")
    rest = warm.where("hot is null").drop("hot").join(firsts.where(F.col("n") <= hot_share * total).select(*key, "first"), key, "left")
    both = of_hot.select(rest.columns).unionByName(rest)
    own = (F.col("first.archive") == F.col("archive")) & (F.col("first.chunk") == F.col("chunk")) & (F.col("first.place") == F.col("place"))
    original = F.struct(F.col("first.page_id").alias("page_id"), F.col("first.uri").alias("uri"), F.col("first.record_id").alias("record_id"), F.col("first.date").alias("date"))
    return both.withColumn("original", F.when(F.col("first").isNotNull() & ~own, original)).drop("first")


def deduplicate_archives(archives: DataFrame, resolved: DataFrame) -> DataFrame:
    """Archives with fresh headers in which revisits have no payload. Decisions meet their chunk by its key; a chunk has
    as many as it has records."""
    decided = resolved.groupBy("archive", "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "original"))).alias("decisions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, chunk, data, decisions in zip(*(column(batch, x).to_pylist() for x in ("archive", "chunk", "data", "decisions")), strict=True):
                out = []
                for (h, block), d in zip(read_records(data), decisions, strict=True):
                    o = d["original"]
                    keep = [(k, h.get(k)) for k in ("WARC-Date", "WARC-Target-URI", "X-Target-URI", "WARC-Payload-Digest", "Content-Type", "X-Page-Id", "X-Payload-Length")]
                    fresh = ("WARC-Record-ID", _record_id("deduplicated", h["WARC-Record-ID"]))
                    if o is None:
                        out.append(write_record([("WARC-Type", "response"), fresh, *keep], block))
                    else:
                        refers = [
                            ("WARC-Profile", PROFILE),
                            ("WARC-Refers-To", _record_id("deduplicated", o["record_id"])),
                            ("WARC-Refers-To-Target-URI", dict(uri_headers(o["uri"])).get("WARC-Target-URI")),
                            ("WARC-Refers-To-Date", o["date"]),
                            ("X-Refers-To-Page-Id", None if o["page_id"] is None else str(o["page_id"])),
                        ]
                        out.append(write_record([("WARC-Type", "revisit"), fresh, *keep, *refers], block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"))
                yield _chunk(archive, chunk, out)

    joined = archives.join(decided, ["archive", "chunk"])
    return joined.select("archive", "chunk", "data", "decisions").mapInArrow(run, CHUNKS)


def read_pages(archives: DataFrame) -> DataFrame:
    """One row for each record of deduplicated archives. The digest of a response is taken from its payload again, and a
    difference from its header is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in column(batch, "data").to_pylist():
                rows = []
                for h, block in read_records(data):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (payload_digest(payload), len(payload)) != (digest, size):
                            raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't have its digest")
                    page, other = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                    rows.append((None if page is None else int(page), size, digest, h["WARC-Type"], None if other is None else int(other)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("data").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def export_archives(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as NAME.warc.gz into a folder that every executor reaches (any file system pyarrow knows), under a
    name of the attempt first; archive and bytes of each. Chunks of an archive stream in order, none is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        from pyarrow.fs import FileSystem

        fs, folder = FileSystem.from_uri(uri)
        fs.create_dir(folder)
        rows = ((a, d) for b in batches for a, d in zip(column(b, "archive").to_pylist(), column(b, "data").to_pylist(), strict=True))
        for archive, parts in groupby(rows, key=lambda x: x[0]):
            held, size = f"{folder}/.{archive}-{uuid.uuid4().hex}", 0
            with fs.open_output_stream(held, compression=None) as f:
                for _, data in parts:
                    size += f.write(data)
            fs.move(held, f"{folder}/{archive}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([size], pa.int64())], ["archive", "bytes"])

    ordered = archives.repartition("archive").sortWithinPartitions("archive", "chunk")
    return ordered.mapInArrow(run, "archive string, bytes bigint")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives, deduplicate them, and give one row for each page as read back from the result."""
    raw = materialize(write_archives(pages), "warc-raw")
    headers = materialize(read_headers(raw), "warc-headers")
    return read_pages(materialize(deduplicate_archives(raw, resolve_revisits(headers, min_bytes)), "warc"))
