"""Readers and writers of source trees, context files and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.functions import text as X

EXTENSIONS = (".java",)
EXCLUDED = (".git", "build", "target", "node_modules", ".gradle", "gradle")
CONTEXT = ("README.md", "build.gradle.kts", "settings.gradle.kts", "pom.xml")
CONTEXT_CHARS = 6000


def is_excluded(path: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a part of the path is one of the excluded folders."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, excluded)))


def is_test(path: Column, segment: str = "test", start: str = "src/test") -> Column:
    return F.contains(F.concat(F.lit("/"), path), F.lit(f"/{segment}/")) | F.startswith(path, F.lit(start))


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, include_tests: bool = False) -> DataFrame:
    """path (below root), content, loc, is_test of the files of a tree, bad bytes as U+FFFD and line ends as \\n.

    The path filter stands on metadata, so contents of files that it drops aren't read."""
    glob = "*{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.split("://")[-1].rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^.*?" + base.replace(".", r"\.") + "/", "")
    rows = raw.select(below.alias("path"), "content").where(~is_excluded(F.col("path"))).withColumn("is_test", is_test(F.col("path")))
    if not include_tests:
        rows = rows.where(~F.col("is_test"))
    content = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return rows.select("path", content.alias("content"), "is_test").withColumn("loc", X.lines_of_code(F.col("content")))


def with_order(files: DataFrame) -> DataFrame:
    """file_ord from 1 by path. Ranges of paths are sorted apart, then numbered from the counts of the ranges before."""
    parts = files.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    own = parts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("path")))
    sizes = own.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(before.select("part", "before")), "part").withColumn("file_ord", F.col("rank") + F.col("before")).drop("part", "rank", "before")


def read_context(spark: SparkSession, root: str, names: tuple[str, ...] = CONTEXT, chars: int = CONTEXT_CHARS) -> DataFrame:
    """name, text, ord of the context files that are right below root, cut to so many characters."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    name = X.base_name(F.col("path"))
    order = F.array_position(F.array(*map(F.lit, names)), name)
    return raw.select(name.alias("name"), F.left(F.make_valid_utf8(F.col("content").cast("string")), F.lit(chars)).alias("text"), order.alias("ord"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def validate(spark: SparkSession, root: str, cloned: bool = False) -> DataFrame:
    """One row, ok, problem and files: a source tree is there, is a clone if it must be one, and has a file to read."""
    told = lambda n, problem: spark.range(1).select(F.lit(problem is None).alias("ok"), F.lit(problem).cast("string").alias("problem"), F.lit(n).cast("bigint").alias("files"))
    if not _exists(spark, root):
        return told(0, "no such folder")
    if cloned and not _exists(spark, f"{root.rstrip('/')}/.git"):
        return told(0, "no clone: .git is missing")
    n = read_files(spark, root, include_tests=True).agg(F.count("*").alias("n"))
    return n.select((F.col("n") > 0).alias("ok"), F.when(F.col("n") == 0, "no source files").alias("problem"), F.col("n").alias("files"))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Add rows to a Parquet table: what a cache and an event ledger need, without rewriting what is there."""
    (df.write.mode("append").partitionBy(*partition_by) if partition_by else df.write.mode("append")).parquet(path)


def path_prefixes(files: DataFrame) -> DataFrame:
    """One row for each folder of a tree: prefix, depth, files and lines below it."""
    parts = F.split("path", "/")
    up = F.explode(F.sequence(F.lit(1), F.size(parts) - 1))
    rows = files.where(F.contains("path", F.lit("/"))).select("loc", parts.alias("parts"), up.alias("depth"))
    return rows.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("prefix"), "depth", "loc").groupBy("prefix", "depth").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
