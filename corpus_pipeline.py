"""Filtering of the documents table in five stages, each of which works on all that the one before it kept.

1. toxicity: documents that score THRESHOLD or more go.
2. near_duplicates: of each group of near-copies the document with the smallest doc_id stays.
3. repeated_substrings: passages of more than PASSAGE_WORDS words that occur anywhere else are cut out; documents stay.
   They are the maximal runs that repeated strings of PASSAGE_BYTES bytes cover; shorter runs stay, but not from 400 bytes.
4. decontamination: documents in which a window of a benchmark item occurs go.
5. bpe: what is left is encoded and decoded; one row of digests for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import bpe, decontam, minhash, suffix_dedup, toxicity
from sedimenta.llm.common import discard, materialize, read, scope


#: Bytes from which a repeated string is looked at, fewer than 51 words have in 99 of 100 places of the tables, and words
#: above which the run that such strings cover is cut out.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def repeated_substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_dedup.keep_unique(docs, PASSAGE_BYTES, PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeated_substrings", repeated_substrings_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Learned scores, near-duplicate search and BPE have no form in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage reads the Parquet table that its predecessor wrote. A stage's scratch tables go when it has ended, and so does
    what it read."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scope(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if hasattr(before, "scratch_path"):
            discard(before)
    return docs
