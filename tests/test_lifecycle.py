import json
import sys
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import functions as F

from sedimenta import config
from sedimenta.operators import lifecycle as L
from sedimenta.operators import merge

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUDGET = 40


def blocks(n, size=30):
    return L.BLOCK.join(f"b{i} {n:02}" + "x" * size for i in range(n))


def told(name, text):
    """classes and observations of a text, as the calls below make them."""
    return [(name, b.split(" ")[0]) for b in text.split(L.BLOCK)], [f"{name} {len(text.split(L.BLOCK))}"]


def answer(df, name, error=None):
    parts = F.transform(F.split("text", L.BLOCK), lambda b: F.struct(F.lit(name).alias("by"), F.split(b, " ")[0].alias("block")))
    seen = F.array(F.concat(F.lit(name + " "), F.size(F.split("text", L.BLOCK)).cast("string")))
    return df.withColumn("classes", parts).withColumn("observations", seen).withColumn("error", F.lit(None).cast("string") if error is None else error)


def plain(text, failing, depth=0):
    """The same by recursion: classes and observations; None if the whole chunk goes to the heuristic."""
    n = len(text.split(L.BLOCK))
    error = failing(text)
    if error is None:
        return told("model", text)
    if "truncated" not in error or depth == L.DEPTH:
        return None
    if n < 2:
        return told("names", text)
    out = [], []
    every = text.split(L.BLOCK)
    for half in (every[: n // 2], every[n // 2 :]):
        bins, held = [[]], 0
        for b in half:
            t = min(int(len(b) / 3.5) + 1, BUDGET // 2)
            if bins[-1] and held + t > BUDGET // 2:
                bins.append([])
                held = 0
            bins[-1].append(b)
            held += t
        for part in bins:
            got = plain(L.BLOCK.join(part), failing, depth + 1)
            if got is None:
                return None
            out[0].extend(got[0]), out[1].extend(got[1])
    return out


def failing(text):
    n = len(text.split(L.BLOCK))
    return "denied" if "b7 " in text and n < 3 else "output truncated" if n > 2 or "b3 " in text and n > 1 or text.startswith("b1 ") else None


def test_chunks_are_split_retried_and_told(spark):
    from pyspark.accumulators import AccumulatorParam

    class Texts(AccumulatorParam):
        def zero(self, value):
            return Counter()

        def addInPlace(self, a, b):  # noqa: N802
            return a + b

    sent = spark.sparkContext.accumulator(Counter(), Texts())

    def error_of(text):
        sent.add(Counter([text]))
        return failing(text)

    error = F.udf(error_of, "string").asNondeterministic()
    rows = [("m", i, blocks(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9])]
    chunks = spark.createDataFrame(rows, "module string, chunk int, text string").repartition(3)
    cache = chunks.where("chunk = 4").select(L.X.cache_key(F.lit("map"), F.lit("v1"), F.col("text")).alias("cache_key")).withColumn("classes", F.array(F.struct(F.lit("old").alias("by"), F.lit("b").alias("block")))).withColumn("observations", F.array(F.lit("kept")))
    got = L.map_chunks(chunks, ["module", "chunk"], lambda df: answer(df, "model", error(F.col("text"))), lambda df: answer(df, "names"), cache, BUDGET, model="v1")
    by = {r["chunk"]: r for r in got.chunks.collect()}
    assert by[4]["status"] == "cached" and by[4]["observations"] == ["kept"]
    for _, i, text in rows:
        if i == 4:
            continue
        want = plain(text, failing)
        c, o = want or told("names", text)
        assert ([(x["by"], x["block"]) for x in by[i]["classes"]], by[i]["observations"]) == (c, o)
        assert (by[i]["status"] == "fallback") == (want is None) and (by[i]["error"] is None) == (want is not None)
    lost = {i for i, r in by.items() if r["status"] == "fallback"}
    assert lost and {r["chunk"] for r in got.warnings.collect()} == lost
    assert got.fresh.count() == len(rows) - 1 - len(lost)
    assert {r["status"] for r in by.values()} == {"computed", "split", "cached", "fallback"}
    # However often results are read, each text of each chunk was sent once at its level.
    assert sent.value[rows[4][2]] == 0 and all(sent.value[t] == 1 for _, i, t in rows if i != 4) and set(sent.value.values()) <= {0, 1}


def test_retry_sends_a_row_once_a_level(spark):
    sent = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: sent.add(1) or x, "int").asNondeterministic()
    items = spark.range(20).select(F.col("id").cast("int").alias("x"))
    got = merge.retry_failed(items, lambda df, level: df.withColumn("out", seen("x")).withColumn("ok", F.col("x") % 4 <= level), lambda df: df.withColumn("out", F.lit(-1)))
    assert got.count() == 20 and got.where("status = 'fallback'").count() == 5
    assert sent.value == 20 + 15 + 10


def test_overview(spark):
    context = spark.createDataFrame([("b.md", "two", 2), ("a.md", "one", 1)], "name string, text string, ord int")
    seen = spark.createDataFrame([("m", 2, "later"), ("m", 1, "first")], "module string, ord int, observation string")
    figures = spark.createDataFrame([(json.dumps({"n": 1}),)], "metrics string")
    text = L.overview_input(context, seen, figures, ["ord"])
    body = text.first()["text"]
    assert body.index("one") < body.index("two") < body.index('{"n": 1}') < body.index("[m] first") < body.index("[m] later")
    good = lambda df: df.withColumn("overview", F.create_map(F.lit("purpose"), F.lit("x"))).withColumn("error", F.lit(None).cast("string"))
    bad = lambda df: df.withColumn("overview", F.lit(None).cast("map<string,string>")).withColumn("error", F.lit("no service"))
    made = L.reduce_overview(text, good, {"purpose": ""}, model="v")
    assert (made.first()["status"], made.first()["overview"]) == ("computed", {"purpose": "x"})
    again = L.reduce_overview(text, bad, {"purpose": ""}, made.select("cache_key", "overview"), "v").collect()
    assert [(r["status"], r["overview"]) for r in again] == [("cached", {"purpose": "x"})]
    lost = L.reduce_overview(text, bad, {"purpose": ""}, made.where("false").select("cache_key", "overview"), "v").collect()
    assert [(r["status"], r["overview"]) for r in lost] == [("empty", {"purpose": ""})] and "no service" in lost[0]["warning"]
    assert L.strategy(" your-key-here ", good, bad) is bad and L.strategy(None, good, bad) is bad and L.strategy("k", good, bad) is good
    sizes = spark.createDataFrame([(100,), (8000,)], "tokens int")
    assert "4800" in L.budget_warning(sizes, 4000).first()["message"] and L.budget_warning(sizes, 8192).first()["message"] is None
    assert L.budget_warning(sizes.where("false"), 1).first()["message"] is None


def test_settings(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# note\nLLM_MODEL=one\nexport MAX_TOKENS_PER_CHUNK=5000\nCHARS_PER_TOKEN='4.0'\nINCLUDE_TESTS=True # yes\nANTHROPIC_API_KEY=your-key-here\nodd line\n")
    c = config.settings(file, {"LLM_MODEL": "two", "OUTPUT_PATH": "o"})
    assert (c.model, c.max_tokens_per_chunk, c.chars_per_token, c.include_tests, c.api_key, c.output_path) == ("two", 5000, 4.0, True, "", "o")
    assert config.settings(tmp_path / "none", {}) == config.Config()
