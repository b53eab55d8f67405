import datetime as dt

from sedimenta.streaming import ledger


def test_ledger_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 12, m)
    rows = [("map", "a", 10, 5, False, at(0)), ("map", "a", 10, 5, True, at(1)), ("qa", "b", 4, 2, False, at(9)), ("map", "a", 1, 1, False, at(40))]
    spark.createDataFrame(rows, ledger.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ledger.by_window(ledger.read_ledger(spark, str(tmp_path / "in")))
    ledger.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["start"].minute, r["call_type"]): (r["calls"], r["input"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "map"): (2, 20), (5, "qa"): (1, 4)}  # the last window may still get late events


def test_by_type_is_kept_up(spark, tmp_path):
    rows = [("map", "a", 1_000_000, 0, False, None), ("map", "a", 5, 5, True, None)]
    spark.createDataFrame(rows, ledger.SCHEMA).write.parquet(str(tmp_path / "in"))
    query = ledger.by_type(ledger.read_ledger(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("by_type").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    (r,) = spark.sql("select * from by_type").collect()
    assert (r["calls"], r["cached"], r["cost_usd"]) == (2, 1, 3.0)


def test_new_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.java").write_text("class A { }")
    query = ledger.run_to_end(ledger.new_files(spark, str(tmp_path / "src")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.exception() is None
    assert [r["content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["class A { }"]
