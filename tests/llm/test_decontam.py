import random
import shutil

import brute
import pytest
from messy import messy_rows

from sedimenta.llm import decontam, queries


def key(r):
    return tuple((x is None, x) for x in r)


def test_whole_table(spark, sf_dir, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute.decontamination([(r["doc_id"], r["text"]) for r in small.collect()], items)
    got = [tuple(r) for r in queries.op1_decontamination(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
    assert any(r[2] for r in want)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_messy_tables(spark, messy, empty, monkeypatch, bound):
    monkeypatch.setattr(decontam, "BROADCAST_TERMS", bound)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", bound)
    base = next(r[1] for r in messy_rows() if r[0] == 5)
    items = [(1, " ".join(base.split()[10:30])), (1, "one two three"), (2, "ONE"), (3, ""), (4, None), (None, "idiot! you, are"), (5, "a a a a a a a a a a"), (6, "é ü"), (7, "never seen words")]
    table = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as row", "2 as pos", "3 as tid")
    rows = [(r[0], r[1]) for r in messy_rows()]
    got = [tuple(r) for r in decontam.contamination(messy, table).collect()]
    assert sorted(got, key=key) == sorted(brute.decontamination(rows, items), key=key)
    assert decontam.contamination(empty, table).count() == 0
    none = decontam.contamination(messy, table.where("false")).collect()
    assert len(none) == len(rows) and not any(r["n_hit"] or r["contaminated"] for r in none)
    kept = [r[1] for r in decontam.keep_uncontaminated(messy, table).collect()]
    clean = [t for (_, t), r in zip(rows, brute.decontamination(rows, items, items_from=1), strict=True) if not r[-1]]
    assert sorted(kept, key=repr) == sorted(clean, key=repr)
    assert decontam.keep_uncontaminated(messy, table).columns == messy.columns


def test_few_words_again_and_again(spark):
    """Repeated terms, so that windows overlap themselves."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(30)]
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for size in (4, 8):
        got = [tuple(r) for r in decontam.contamination(docs, table, size).collect()]
        assert sorted(got) == sorted(brute.decontamination(rows, items, size))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x q1 q2 q3 q4 y"), (2, "q1 z q2 q3 z q4"), (3, "q1 q2 z z z z q3 q4"), (4, "q2 q1 q3 q4"), (5, "q1 q2 q3")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "q1 q2 q3 q4")], "item_id bigint, text string")
    index = decontam.lists_of(docs, items)
    ids = {r["row"]: r["doc_id"] for r in index.lengths().collect()}
    near = lambda slop: {ids[r["row"]] for r in decontam.proximity_matches(index, slop, 4).collect()}
    assert near(0) == {1} == {ids[r["row"]] for r in decontam.phrase_matches(index, 4).collect()}
    assert near(2) == {1, 2, 4}
    assert near(4) == {1, 2, 3, 4}


def test_one_index_for_several_benchmarks(spark, tmp_path):
    """Texts are split once; with the texts gone, two benchmarks are searched in the index."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80)))) for i in range(60)] + [(None, "a b c d e f g h"), (3, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    index = decontam.build_index(spark.read.parquet(str(tmp_path / "docs")))
    shutil.rmtree(tmp_path / "docs")
    for size in (3, 4):
        items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(20)]
        lists = index.lists(spark.createDataFrame(items, "item_id bigint, text string"))
        got = [tuple(r) for r in decontam.contamination_of(lists, size).collect()]
        assert sorted(got, key=key) == sorted(brute.decontamination(rows, items, size), key=key) and any(r[2] for r in got)


def test_no_python_in_plans(spark, messy):
    table = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    plan = decontam.contamination(messy.select("doc_id", "text"), table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
