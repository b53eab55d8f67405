"""Python workers find this package where the driver found it, if they have no other way to; tables that are stored on the way."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the path of workers that start from now on. On a cluster the package is installed or sent
    along; there a folder that isn't there does no harm."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


#: Spark's default for rows in a batch to Python, and what whole texts get instead.
DEFAULT_ROWS, TEXT_ROWS = "10000", "500"


def small_batches(spark: SparkSession) -> SparkSession:
    """A session that has the default for rows in a batch to Python gets TEXT_ROWS; one that has chosen a number keeps it."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return spark


def stored(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the folder of spark.checkpoint.dir, which all executors share. Where that is unset, a single
    machine gets a temporary folder, and a cluster an error."""
    spark = reach(df.sparkSession)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sedimenta-"))
    return df.checkpoint()
