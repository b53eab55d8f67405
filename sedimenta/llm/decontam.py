"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions alone.

The index holds a posting (row, pos, term) for every place in a training text, in order of terms within each file, and one
of the empty term behind the last word of each text: its place is the text's length. It is written once and serves any
number of benchmarks: a search takes the lists of its own terms from it, numbered, and the empty one as number 0. Where
there is one benchmark only, the same lists are taken from the texts as they are split, and no others are stored.

A search looks for windows of consecutive item words. For each window the lists are taken from its rarest term on. The
lists of rarest terms, moved by the term's place in the item, give alignments of text and item; those of the second
rarest terms are intersected with them; what is left, hardly more than true matches, is intersected with the lists of
all terms of the item, and the runs of matching places at least as long as a window are exact phrase matches.
proximity_matches() lets each term stray from its place by up to slop words.

Null texts have no words, null items none; both are kept in the results. Repeated rows are searched each by itself,
repeated item_ids count once. Items of fewer words than a window are one window; those without words match nothing.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import keyed, materialize

WINDOW = 8

#: Terms, and ids of texts, up to which a table of them may be broadcast: some tens of MB. More of them are shuffled.
BROADCAST_TERMS = 500_000
BROADCAST_ROWS = 1_000_000

#: Tasks that a term's list is dealt to where pairs of terms are joined by shuffle.
SALT = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased. Where all is ASCII the plain function does it, and faster."""
    small = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(small, _BETWEEN), ""), F.array().cast("array<string>"))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, by count; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def item_places(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """item (its id as text), ipos, term and n, the words of the item; items of equal ids are told apart by copy."""
    one = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.monotonically_increasing_id().alias("copy"), words(F.col("text")).alias("words"))
    return one.select("item", "copy", F.size("words").alias("n"), F.posexplode("words").alias("ipos", "term"))


@dataclass
class Lists:
    """The postings (row, doc_id, pos, tid) of training texts for the terms of some items, and those items' places with the
    terms' numbers."""

    postings: DataFrame
    places: DataFrame

    def lengths(self) -> DataFrame:
        """row, doc_id and n_words of every text."""
        return self.postings.where("tid = 0").select("row", "doc_id", F.col("pos").cast("bigint").alias("n_words"))


def _all_postings(docs: DataFrame) -> DataFrame:
    """row, doc_id (at the empty term only), pos and term of every word, and of the empty term behind the last one."""
    tokens = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("words"))
    every = tokens.select("row", "doc_id", F.posexplode("words").alias("pos", "term"))
    return every.select("row", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"), "pos", "term")


@dataclass
class Index:
    """Postings of training texts for all their terms."""

    postings: DataFrame

    def lists(self, items: DataFrame, item_id: str = "item_id") -> Lists:
        """The lists that a search for items needs."""
        return _lists(self.postings, items, item_id)


def build_index(docs: DataFrame) -> Index:
    """Store the postings of all texts. Each file is in order of terms, so a term's list stands together in it."""
    return Index(materialize(_all_postings(docs).sortWithinPartitions("term", "row", "pos"), "index"))


def _lists(postings: DataFrame, items: DataFrame, item_id: str) -> Lists:
    places = materialize(item_places(items, item_id), "items")
    terms = materialize(places.select("term").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("tid")), "terms")
    known = terms.unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("bigint").alias("tid")))
    stored = materialize(postings.join(_bounded(known, BROADCAST_TERMS), "term").select("row", "doc_id", "pos", "tid"), "postings")
    return Lists(stored, materialize(places.join(_bounded(terms, BROADCAST_TERMS), "term").select("item", "copy", "n", "ipos", "tid"), "places"))


def lists_of(docs: DataFrame, items: DataFrame, item_id: str = "item_id") -> Lists:
    """The lists that a search for items needs, straight from the texts."""
    return _lists(_all_postings(docs), items, item_id)


def windows(index: Lists, size: int = WINDOW) -> DataFrame:
    """Slots of each window that can occur at all: item, copy, start, length, ipos, tid and rank, 1 for its rarest term."""
    often = index.postings.where("tid <> 0").groupBy("tid").agg(F.count("*").alias("freq"))
    p = index.places.join(often, "tid", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    length = F.least(F.col("n"), F.lit(size))
    starts = F.sequence(F.greatest(F.col("ipos") - length + 1, F.lit(0)), F.least(F.col("ipos"), F.col("n") - length))
    slots = p.select("item", "copy", "n", length.alias("length"), "ipos", "tid", "freq", F.explode(starts).alias("start"))
    one = Window.partitionBy("item", "copy", "start")
    ranked = slots.withColumn("least", F.min("freq").over(one)).where("least > 0").withColumn("rank", F.row_number().over(one.orderBy("freq", "tid", "ipos")))
    return ranked.select("item", "copy", "n", "start", "length", "ipos", "tid", "rank")


def _alignments(index: Lists, slots: DataFrame, slop: int = 0) -> DataFrame:
    """row, item, copy, diag (place in the text less place in the item) at which a window's two rarest terms both stand."""
    key = ["item", "copy", "start"]
    first = slots.where("rank = 1").select(*key, "length", F.col("ipos").alias("first_ipos"), F.col("tid").alias("first_tid"))
    second = slots.where("rank = 2").select(*key, F.col("ipos").alias("second_ipos"), F.col("tid").alias("second_tid"))
    pairs = first.join(second, key, "left").select("item", "copy", "first_ipos", "first_tid", "second_ipos", "second_tid").distinct()
    pairs = materialize(pairs, "pairs")
    lists = index.postings.select("row", "pos", "tid").where("tid <> 0")
    found = _with_first(lists, pairs.withColumnRenamed("first_tid", "tid")).withColumn("diag", F.col("pos") - F.col("first_ipos")).drop("tid", "pos")
    only = found.where("second_tid is null").select("row", "item", "copy", "diag")  # windows of one word
    stray = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    wanted = found.where("second_tid is not null").select("row", "item", "copy", "diag", F.col("second_tid").alias("tid"), stray.alias("stray"), "second_ipos")
    wanted = wanted.withColumn("pos", F.col("diag") + F.col("second_ipos") + F.col("stray"))
    seconds = _bounded(pairs.where("second_tid is not null").select(F.col("second_tid").alias("tid")).distinct(), BROADCAST_TERMS)
    both = wanted.join(lists.join(seconds, "tid", "left_semi"), ["row", "tid", "pos"]).select("row", "item", "copy", "diag")
    return materialize(both.unionByName(only).distinct(), "alignments")


def _with_first(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """lists with the pairs whose rarest term they are of. Too many pairs to be broadcast are joined by shuffle; there a hot
    term's list is dealt to SALT tasks by its rows, and each gets all its pairs."""
    if pairs.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return lists.join(F.broadcast(pairs), "tid")
    salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return lists.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, ["tid", "salt"]).drop("salt")


def _matches(index: Lists, aligned: DataFrame, slop: int = 0) -> DataFrame:
    """row, item, copy, n, diag, ipos, pos: the places at which an aligned item's terms stand in the text."""
    rows = _bounded(materialize(aligned.select("row").distinct(), "rows"), BROADCAST_ROWS)
    lists = index.postings.select("row", "pos", "tid").where("tid <> 0").join(rows, "row", "left_semi")
    stray = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    wanted = aligned.join(_bounded(index.places, BROADCAST_TERMS), ["item", "copy"]).select("*", stray.alias("stray"))
    wanted = wanted.withColumn("pos", F.col("diag") + F.col("ipos") + F.col("stray"))
    return wanted.join(lists, ["row", "tid", "pos"]).select("row", "item", "copy", "n", "diag", "ipos", "pos", "stray")


def phrase_matches(index: Lists, size: int = WINDOW) -> DataFrame:
    """row, item, first, last: runs of a text's words that windows of an item, as many as overlap, cover exactly."""
    at = ["row", "item", "copy", "diag"]
    hit = _matches(index, _alignments(index, windows(index, size)))
    run = hit.withColumn("run", F.col("ipos") - F.row_number().over(Window.partitionBy(*at).orderBy("ipos")))
    runs = run.groupBy(*at, "n", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(size))).select("row", "item", "first", "last")


def proximity_matches(index: Lists, slop: int, size: int = WINDOW) -> DataFrame:
    """row, item, start, first, last: windows whose terms all stand within slop words of their places in some alignment with
    the rarest term."""
    slots = materialize(windows(index, size), "slots")
    near = _matches(index, _alignments(index, slots, slop), slop)
    near = near.groupBy("row", "item", "copy", "diag", "ipos").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    own = near.join(slots.select("item", "copy", "start", "length", "ipos"), ["item", "copy", "ipos"])
    full = own.groupBy("row", "item", "copy", "diag", "start", "length").agg(F.count("*").alias("places"), F.min("low").alias("first"), F.max("high").alias("last"))
    return full.where("places = length").select("row", "item", "start", "first", "last").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, items_from: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    return contamination_of(lists_of(docs, items), size, items_from)


def contamination_of(index: Lists, size: int = WINDOW, items_from: int = 2) -> DataFrame:
    """The same of texts that were indexed before."""
    found = materialize(phrase_matches(index, size), "phrases")
    # Runs of one text may overlap: those that do are merged before their words are counted.
    order = Window.partitionBy("row").orderBy("first", "last")
    reach = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    new = found.select("row", "first", "last").distinct().withColumn("reach", reach)
    hits = new.groupBy("row").agg(F.sum(F.greatest(F.col("last") - F.greatest(F.col("first"), F.col("reach") + 1) + 1, F.lit(0))).alias("n_hit"))
    named = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("found_items"))
    every = index.lengths().join(hits, "row", "left").join(named, "row", "left")
    n_items = F.coalesce(F.size("found_items"), F.lit(0)).cast("bigint")
    return every.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.when(F.col("found_items").isNull(), F.lit(0).cast("bigint")).otherwise(n_items).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("found_items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.col("found_items").isNotNull() & (n_items >= items_from)).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, items_from: int = 1) -> DataFrame:
    """The rows of docs in which windows of fewer than items_from items occur; all columns as they are."""
    rows, row = keyed(docs)
    found = contamination(rows.select(F.col(row).alias("doc_id"), "text"), items, size, items_from).where("contaminated")
    bad = materialize(found.select(F.col("doc_id").alias(row)), "contaminated")
    return rows.join(_bounded(bad, BROADCAST_ROWS), row, "left_anti").select(docs.columns)
