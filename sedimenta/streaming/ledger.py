"""The call ledger as a stream: events are appended as files, sums by type are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sedimenta.operators import telemetry

SCHEMA = "call_type string, module string, input_tokens bigint, output_tokens bigint, cached boolean, ts timestamp"


def read_ledger(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def by_type(events: DataFrame) -> DataFrame:
    """Sums by call type over the whole stream."""
    return telemetry.by_type(events)


def by_window(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sums by call type and window of time; a window is given out once nothing can come for it any more."""
    timed = telemetry.with_cost(events.withWatermark("ts", late))
    sums = timed.groupBy(F.window("ts", window), "call_type").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum("cost_usd").alias("cost_usd"))
    return sums.select(F.col("window.start").alias("start"), "call_type", "calls", "input", "output", "cost_usd")


def new_files(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """Files as they appear in a tree, for analysis of what is new only."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("content"))


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there now to Parquet and stop."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return query
