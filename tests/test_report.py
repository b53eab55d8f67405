import json
import subprocess

import pytest
from pyspark.sql import functions as F

from sedimenta import cli
from sedimenta.functions import text as X
from sedimenta.operators import deps, javaparse, knowledge, metrics, report
from sedimenta.plans import corpus
from sedimenta.sources import files as S
from sedimenta.sources import git


@pytest.fixture(scope="module")
def tables(spark):
    return knowledge.analyse(corpus.files(spark).where("path like 'src/main%'"))


def test_rows(spark, tables):
    files = corpus.files(spark).withColumn("loc", X.lines_of_code(F.col("content")))
    assert [r["file"] for r in report.file_rows(files).limit(2).collect()] == ["FilmServiceImpl.java", "FilmController.java"]
    assert [r["method"] for r in report.hotspot_rows(metrics.hotspots(tables["methods"])).collect()] == ["save", "find"]
    kinds = {r["kind"] for r in report.dependency_rows(deps.unique_dependencies(deps.dependency_matches(corpus.files(spark)))).collect()}
    assert kinds == {"Database", "Cache", "Rest Client", "Messaging"}
    assert [r["table"] for r in report.table_rows(deps.db_tables(corpus.files(spark))).collect()] == ["film", "thing"]


def test_filters(spark):
    rows = spark.createDataFrame([("high", "secret", 1), ("info", "smell", 2), ("low", "secret", 3)], "severity string, category string, rule_ord int")
    assert report.filter_findings(rows).count() == 1 and report.filter_findings(rows, ("low", "info"), ["smell"]).count() == 1
    assert report.finding_rows(rows).columns == ["severity", "category"]


def test_reduce_input_and_usage(spark, tables):
    got = json.loads(report.reduce_input(metrics.totals(tables["classes"]), metrics.role_counts(tables["classes"]), metrics.complexity_summary(tables["methods"])).first()["metrics"])
    assert got["totals"]["methods"] == 11 and got["class_roles"]["controller"] == 1 and got["cyclomatic_complexity"]["max"] == 7
    rows = spark.createDataFrame([('{"usage": {"input_tokens": 3, "output_tokens": 4}}',), ('{"usage": {"prompt_tokens": 5}}',), (None,)], "response string")
    assert [(r["input_tokens"], r["output_tokens"]) for r in report.usage(rows).collect()] == [(3, 4), (5, 0), (0, 0)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.clean_key(F.lit(" your-key-here "))) == "" and one(X.clean_key(F.lit(None).cast("string"))) == "" and one(X.clean_key(F.lit(" k "))) == "k"
    assert one(X.with_credentials(F.lit("https://h/x"), F.lit("t$1"))) == "https://t$1@h/x" and one(X.with_credentials(F.lit("git@h:x"), F.lit("t"))) == "git@h:x"
    assert one(X.clock_time(F.lit(3661))) == "01:01:01" and one(X.now_iso()).startswith("20") and one(X.progress(F.lit(1), F.lit(2))) == pytest.approx(0.62)
    assert one(X.progress_kind(F.lit("step FAILED"))) == "warning" and one(X.title(F.lit("rest_client"))) == "Rest Client"
    assert one(X.recommended_output_tokens(F.lit(8001))) == 4800 and one(X.test_stem(F.lit("a/FooTests.java"))) == "foo"


def test_clone(tmp_path):
    source = tmp_path / "source"
    source.mkdir()
    (source / "A.java").write_text("class A { }")
    git_ = lambda *a: subprocess.run(["git", "-C", str(source), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git_("init", "-q"), git_("add", "."), git_("commit", "-qm", "x")
    assert (tmp_path / "copy/A.java").exists() is False
    git.clone(f"file://{source}", str(tmp_path / "copy"))
    assert (tmp_path / "copy/A.java").read_text() == "class A { }"
    with pytest.raises(RuntimeError):
        git.clone(f"file://{tmp_path}/none", str(tmp_path / "other"))
    assert git.scrub("https://tok@h failed", "tok") == "https://***@h failed"


def test_command_line(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/Film.java").write_text(corpus.FILES["src/main/java/com/acme/services/film/FilmController.java"])
    run = lambda *a: cli.run(spark, cli.parser().parse_args(a))
    run("analyse", "--repo", str(tmp_path / "tree"), "--output", str(tmp_path / "out"))
    document = json.loads(spark.read.text(str(tmp_path / "out/knowledge")).first()[0])
    assert document["statistics"]["totals"]["methods"] == 4 and document["modules"][0]["module"] == "services.film"
    assert "### Source 1" in run("ask", "--knowledge", str(tmp_path / "out"), "-q", "who removes films", "--top-k", "2")


def test_reports_settings_and_questions(spark, tmp_path):
    """Every report is written, observations are in the document, questions are read one by one, vectors come from a function."""
    import json

    from sedimenta.plans import corpus

    for path, content in corpus.FILES.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(content)
    (tmp_path / "seen.json").write_text(json.dumps([{"module": "common", "ord": 2, "observation": "second"}, {"module": "common", "ord": 1, "observation": "first"}, {"module": "nowhere", "ord": 1, "observation": "lost"}]))
    run = lambda *a, **k: cli.run(spark, cli.parser().parse_args(a), **k)
    tree, out = str(tmp_path / "tree"), str(tmp_path / "out")
    run("report", "--repo", tree, "--output", out)
    severities = {r["severity"]: r["n"] for r in spark.read.json(f"{out}/security/summary").collect()}
    assert severities["critical"] == 2 and spark.read.json(f"{out}/security/findings").count() == sum(severities.values())
    assert {r["type"] for r in spark.read.json(f"{out}/dependencies/integrations").collect()} >= {"JpaRepository", "@Cacheable", "KafkaTemplate"}
    assert spark.read.json(f"{out}/dependencies/tables").count() == 2 and spark.read.json(f"{out}/dependencies/clients").count() == 1
    assert spark.read.json(f"{out}/flows/endpoints").count() == 3 and spark.read.json(f"{out}/flows/consumers").count() == 1
    run("analyse", "--repo", tree, "--output", out, "--observations", str(tmp_path / "seen.json"))
    modules = {m["module"]: m.get("observations") for m in json.loads(spark.read.text(f"{out}/knowledge").first()[0])["modules"]}
    assert modules["common"] == ["first", "second"] and "nowhere" not in modules
    nodes = {r["id"]: r["text"] for r in spark.read.parquet(f"{out}/nodes").collect()}
    assert nodes["module::common"].endswith("- first\n- second") and "module::nowhere" not in nodes
    said, asked = [], iter(["Which class handles films?", "listener of orders", ""])
    assert run("ask", "--knowledge", out, "--top-k", "1", ask=lambda: next(asked), say=said.append) == "2 questions" and len(said) == 2
    assert "Controller" in run("ask", "--knowledge", out, "-q", "Films over HTTP", "--mode", "vector", "--embed", "sedimenta.plans.corpus:letters")
    events = spark.createDataFrame([("map", "m", 10, 5, False)], "call_type string, module string, input_tokens bigint, output_tokens bigint, cached boolean")
    events.write.parquet(str(tmp_path / "events"))
    run("telemetry", "--events", str(tmp_path / "events"), "--output", out)
    assert spark.read.json(f"{out}/telemetry").count() == 1
    assert not S.validate(spark, tree, cloned=True).first()["ok"] and S.validate(spark, tree).first()["files"] == 8
    (tmp_path / "tree" / ".git").mkdir()
    assert S.validate(spark, tree, cloned=True).first()["ok"]


def test_questions_in_batches(spark):
    from sedimenta.operators import retrieval

    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    nodes = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = nodes.where("id % 10 = 0").selectExpr("id as query_id", "embedding as vector")
    got = retrieval.vector_top_k_batch(nodes, asked, 4)
    for q in (0, 30):
        one = [(r["id"], r["score"]) for r in retrieval.vector_top_k(nodes, rows[q][1], 4).collect()]
        assert [(r["id"], r["score"]) for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == one


def test_questions_in_batches_sort_no_pairs(spark):
    """No sort, limit or join stands over pairs of nodes and questions: a task gives k rows a question."""
    from sedimenta.operators import retrieval

    nodes = spark.range(0, 3000, 1, 3).selectExpr("id", "array(float(id % 53), float(id % 7 - 3), 1f) as embedding")
    asked = nodes.where("id % 100 = 0").selectExpr("id as query_id", "embedding as vector")
    got = retrieval.vector_top_k_batch(nodes, asked, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 30 * 4


def test_questions_in_batches_against_sql(spark, monkeypatch):
    """Copies, ties at the last place, vectors of zeros, nulls in and for vectors, other lengths; in several blocks and batches."""
    import math
    import random

    import duckdb

    from sedimenta.operators import retrieval, topk
    from sedimenta.plans import tables

    r = random.Random(5)
    near = [[1.0, 2.0, 3.0 + i * 1e-5] for i in range(40)]
    odd = [[0.0, 0.0, 0.0], [0.0, 0.0, 0.0], None, None, [None, None, None], [], [1.0, None, 2.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [*odd, *([1.0, 1.0, 1.0] for _ in range(60)), *near, *([r.gauss(0, 1) for _ in range(3)] for _ in range(300))]
    r.shuffle(rows)
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(rows)]
    nodes = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(3)
    asked = nodes.where("id % 3 = 0").selectExpr("id as query_id", "embedding as vector")
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    sql = tables.SQL["cosine_topk_batch"].replace("vec_id % 100 = 0", "vec_id % 3 = 0")
    plain = lambda rows: sorted((q, n, i, s if s is None or math.isnan(s) is False else "nan") for q, i, s, n in rows)
    want = plain(con.execute(f"select query_id, id, score, rank from ({sql})").fetchall())
    for numbers in (topk.NUMBERS, 100):
        monkeypatch.setattr(topk, "NUMBERS", numbers)
        got = retrieval.vector_top_k_batch(nodes, asked, 5, places=4)
        assert plain(got.select("query_id", "id", "score", "rank").collect()) == want


def test_best_rows_in_small_batches():
    """The best of rows that come in batches, ascending and tied, are those of a sort of all."""
    import numpy as np
    import pyarrow as pa

    from sedimenta.operators import topk

    r = np.random.default_rng(3)
    scores = topk.rounded(np.sort(r.random((900, 7)), axis=0), 2)
    best = topk.Best(7, 5)
    for lo in range(0, 900, 60):
        at, q = best.worth(scores[lo : lo + 60], 0, 0.01)
        best.add(q, scores[lo : lo + 60][at, q], at, pa.array(range(lo, lo + 60)))
    for q in range(7):
        assert [x for _, _, x in best.rows[q]] == sorted(range(900), key=lambda i: (-scores[i, q], i))[:5]
    assert topk.rounded(np.array([0.00005, -0.00005, 0.00004, np.nan, 2.5]), 4).tolist()[:3] == [0.0001, -0.0001, 0.0]


def test_terms_are_searched_without_postings(spark, tmp_path):
    """Nothing by term and node, or by query and node, is shuffled: the plan has the exchange of the best rows alone."""
    from sedimenta.operators import retrieval

    spark.range(0, 600, 1, 3).selectExpr("id", "concat('common w', id % 50, ' v', id % 7) as text").write.parquet(str(tmp_path / "nodes"))
    asked = spark.createDataFrame([(1, "common w3"), (2, "V2 w7, common"), (3, "none"), (4, None), (5, "")], "query_id bigint, text string")
    got = retrieval.bm25(spark.read.parquet(str(tmp_path / "nodes")), asked, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Generate" not in plan
    assert {(r["query_id"], r["n"]) for r in got.groupBy("query_id").count().withColumnRenamed("count", "n").collect()} == {(1, 4), (2, 4)}


def test_terms_against_sql(spark, monkeypatch):
    """Copies, nulls, empty texts, a term in every text, letters beyond ASCII, names for ids; in several blocks and batches."""
    import random

    import duckdb

    from sedimenta.operators import retrieval, topk
    from sedimenta.plans import tables

    r = random.Random(8)
    words = ["all", *(f"w{i}" for i in range(40)), "Ärger", "x_1", "naïve"]
    texts = [None, "", " ..; ", *["all w1 w2"] * 30, *(" ".join(["ALL", *r.choices(words, k=r.randint(0, 60))]) for _ in range(400))]
    r.shuffle(texts)
    items = [None, "", "nothing here", "all", *(", ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(30))]
    docs, asked = list(enumerate(texts)), list(enumerate(items))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.execute("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", asked)
    want = sorted(con.execute(f"select query_id, rank, id, score from ({tables.SQL['bm25_topk']})").fetchall())
    nodes = spark.createDataFrame(docs, "id bigint, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id bigint, text string")
    rounded = lambda df: sorted((x["query_id"], x["rank"], x["id"], round(x["score"], 4)) for x in df.collect())
    got = rounded(retrieval.bm25(nodes, queries))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1.01e-4 for a, b in zip(got, want, strict=True))
    monkeypatch.setattr(topk, "ASKED", 40)
    assert rounded(retrieval.bm25(nodes, queries)) == got
    named = retrieval.bm25(nodes.selectExpr("lpad(string(id), 5, '0') as id", "text"), queries)
    assert [(q, n, int(i), s) for q, n, i, s in rounded(named)] == got
    assert not retrieval.bm25(nodes.where("false"), queries).collect() and not retrieval.bm25(nodes, queries.where("false")).collect()


def test_scores_are_rounded_as_in_sql(spark, tmp_path, monkeypatch):
    """Scores that end in a 5 at the fifth place: the double decides, as in DuckDB's round()."""
    import duckdb

    from sedimenta.operators import retrieval
    from sedimenta.plans import tables

    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([(1, "a")], f"{key} bigint, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    scores = [130.58995, *(round(i + i * 0.01 + 0.00005, 6) for i in range(1, 200))]
    monkeypatch.setattr(retrieval, "bm25", lambda *a: spark.createDataFrame([(1, i, i, s) for i, s in enumerate(scores)], "query_id int, id int, rank int, score double"))
    got = {r["id"]: r["score"] for r in tables.bm25_topk(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    assert [got[i] for i in range(len(scores))] == [con.execute("select round(?::double, 4)", [s]).fetchall()[0][0] for s in scores]
