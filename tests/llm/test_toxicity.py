import zlib

import numpy as np
import pytest
from messy import messy_rows

from sedimenta.llm import queries
from sedimenta.llm import toxicity as T


def test_features():
    f = T.Featurizer(T.Lexicon(frozenset({"vile"}), frozenset({"gros"})))
    rows = f.of(["", "You are an IDIOT, truly!", "st*pid id1ot i.d.i.o.t vile grossling", "calm words only", "x you " + "calm " * 20 + "idiot"])
    get = lambda name: rows[:, T.NAMES.index(name)].tolist()
    assert (rows[0] == 0).all()
    assert get("base") == [0, 1, 0, 0, 1] and get("near") == [0, 1, 0, 0, 0]
    assert get("masked") == [0, 0, 3, 0, 0] and get("learned") == [0, 0, 1, 0, 0] and get("stem") == [0, 0, 1, 0, 0]
    assert get("capitals")[1] == pytest.approx(6 / 18)


def test_lexicon_ignores_copies():
    toxic = ["grumbf one two three four five"] * 9 + [f"vilest{i} a{i} b{i} c{i} d{i}" for i in range(9)]
    clean = [f"calm x{i} y{i} z{i}" for i in range(60)]
    lexicon = T.learn_lexicon(toxic + clean, np.array([1] * 18 + [0] * 60))
    assert "grumbf" not in lexicon.learned and "viles" in lexicon.stems


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)).astype(float)
    trees = T.boost(x[:1000], y[:1000], np.ones(1000))
    assert np.mean((trees.raw(x[1000:]) > 0) == y[1000:]) > 0.95
    knots = T.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert knots[1].tolist() == [0, 0.5, 1] and knots[0].tolist() == [1, 2.5, 4]
    assert trees.raw(x[:0]).tolist() == []


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_held_out_documents(spark, larger):
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    got = queries.op9_toxicity(spark, larger)
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == 1000 and all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    pos, neg = ([r["score"] for r in held if r["toxic"] == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.8 and np.mean([s >= 0.3 for s in neg]) < 0.05


def test_held_out_labels_are_not_seen(spark, larger):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    a = T.train(docs, labels)
    b = T.train(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert a.lexicon == b.lexicon and (a.trees.value == b.trees.value).all()


def test_messy_table(spark, messy, empty):
    labels = spark.createDataFrame([(15, 1, 1), (15, 0, 0), (3, None, 0), (4, 1, None), (99, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int").withColumn("text", labels_text())
    for model in (T.train(messy, labels), T.train(empty, labels), T.train(messy, labels.where("false"))):
        got = T.score(messy, model).collect()
        assert len(got) == len(messy_rows()) and all(0 <= r["score"] <= 1 for r in got)
        by = {r["doc_id"]: r for r in got}
        assert by[15]["predicted"] == 1 and by[0]["score"] == by[1]["score"] and by[5] ["score"] == by[6]["score"] == by[None]["score"]
        assert T.score(empty, model).count() == 0
        kept = T.keep_clean(messy, model)
        assert kept.columns == messy.columns and kept.where("doc_id = 15").count() == 0 and kept.where("doc_id = 0").count() == 1


def labels_text():
    from pyspark.sql import functions as F

    return F.lit("a column of the same name")


def test_held_out_recall(spark):
    """At the threshold, over the held-out fold of the largest table: toxic texts are caught, others left alone."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    caught, alarms = (np.mean([r["predicted"] for r in rows if r["toxic"] == k]) for k in (1, 0))
    assert caught >= 0.9 and alarms <= 0.01


def test_sample_is_bounded(spark):
    """One text an id, so many ids and characters of a label, however often an id is repeated; ids may be strings."""
    rows = [(f"id{i % 50}", f"text {i} you idiot" if i % 2 else f"calm text {i}") for i in range(3000)] + [("same", "one more copy")] * 3000
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    labels = spark.createDataFrame([(f"id{i}", i % 2) for i in range(50)] + [("same", 0)] * 3, "doc_id string, toxic int")
    sample, totals = T.training_rows(docs, labels, rows=10)
    got = sample.collect()
    assert len(got) == 20 == len({r["doc_id"] for r in got}) and sum(totals.values()) <= 51
    model = T.train(docs, labels, rows=10)
    assert T.score(docs, model).count() == 6000
    assert T.train(docs, labels, rows=10, chars=1).knots is not None
