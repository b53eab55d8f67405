"""What the operators of this subpackage share: scratch tables, batches of texts, word arrays."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.workers import reach

#: Rows that go to a Python worker at once, so that a batch of long texts stays bounded, where the session has no choice of its own.
BATCH_ROWS, BATCH_SETTING = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Arrow batches are cut again so that a step never holds more bytes of text than this.
STEP_BYTES = 2 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share: below spark.checkpoint.dir. Where that is unset a single machine gets a temporary
    one, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Paths of scratch tables written within the open scopes, the innermost last.
_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = reach(df.sparkSession)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for paths in _scopes[-1:]:
        paths.append(path)
    return out


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the scratch tables that are written inside when it ends, but those given to the function that it yields."""
    _scopes.append([])
    kept = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.scratch_path)
        return df

    try:
        yield keep
    finally:
        paths = _scopes.pop()
        for path in paths:
            if path not in kept:
                _delete(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once no result that reads them is needed."""
    _delete(spark, scratch_dir(spark))


def discard(df: DataFrame) -> None:
    """Delete a scratch table that materialize() wrote and nothing reads any more."""
    _delete(df.sparkSession, df.scratch_path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of sf_dir. A session that has Spark's default for rows in a batch to Python gets BATCH_ROWS; one that has chosen
    a number keeps it."""
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return reach(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of docs has in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


#: Rows of narrow keys up to which a table of them may be broadcast: some tens of MB.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, most: int | None = None) -> bool:
    """Whether df has at most so many rows, by count."""
    most = BROADCAST_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of that column, which docs hadn't: the doc_id where that is unique and
    not null; else the table is stored with numbers, so that they stay what they are."""
    name = free_name(docs, "__row")
    n, full, apart = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == full == apart and docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        return docs.withColumn(name, F.col("doc_id").cast("bigint")), name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of the column, and one row at least. When all are read, the worker,
    which Spark uses again, gives free memory back."""
    try:
        yield from _cut_batches(batches, column, limit)
    finally:
        trim()


def trim() -> None:
    """Return memory that this process holds but doesn't use to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _cut_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def joined_batches(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows put together until they have about so many rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held = []
    trim()


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column as one array, and the offsets of its rows; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"", col.type))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
