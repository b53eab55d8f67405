"""Queries over whole texts and tables against plain Python."""

from collections import Counter

from sedimenta.plans import tables


def rows(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_whole_texts_of_nodes(spark, sf_dir):
    texts = {f"class::{r['doc_id']}": r["text"] for r in rows(spark, sf_dir, "documents")}
    got = {r["id"]: r["text"] for r in tables.QUERIES["node_union"](spark, sf_dir).collect()}
    assert max(map(len, texts.values())) > 50
    assert {k: got[k] for k in texts} == texts


def test_whole_texts_of_context(spark, sf_dir):
    best = sorted(rows(spark, sf_dir, "documents"), key=lambda r: (-r["n_chars"], r["doc_id"]))[:5]
    (got,) = tables.QUERIES["context_format"](spark, sf_dir).collect()
    assert len(best[0]["text"]) > 100
    assert got["answer"] == "\n\n".join(f"### Source {k} (score {r['n_chars'] / 1000:.3f}, {r['lang']})\n{r['text']}" for k, r in enumerate(best, 1))


def test_whole_texts_carried_forward(spark, sf_dir):
    want, last = {}, {}
    for r in sorted(rows(spark, sf_dir, "conversations"), key=lambda r: (r["conv_id"], r["turn"])):
        want[r["conv_id"], r["turn"]] = last.get(r["conv_id"])
        if r["role"] == "user" and r["text"] is not None:
            last[r["conv_id"]] = r["text"]
    got = {(r["conv_id"], r["turn"]): r["doc"] for r in tables.QUERIES["javadoc_carry_forward"](spark, sf_dir).collect()}
    assert max(len(x) for x in want.values() if x) > 20
    assert got == want


def test_whole_chain(spark, sf_dir):
    part, supplier, nation, customer, orders = ({r[k]: r for r in rows(spark, sf_dir, t)} for t, k in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")))
    items = [r for r in rows(spark, sf_dir, "lineitem") if r["l_orderkey"] in orders and r["l_partkey"] in part and r["l_suppkey"] in supplier]
    want = Counter((customer[orders[r["l_orderkey"]]["o_custkey"]]["c_mktsegment"], part[r["l_partkey"]]["p_brand"], nation[supplier[r["l_suppkey"]]["s_nationkey"]]["n_name"]) for r in items)
    got = {tuple(r)[:3]: r["n"] for r in tables.QUERIES["call_chain_trace"](spark, sf_dir).select("c_mktsegment", "p_brand", "n_name", "n").collect()}
    assert any(r["l_linenumber"] != 1 for r in items)
    assert got == want


def test_whole_stems(spark, sf_dir):
    part = rows(spark, sf_dir, "part")
    n = Counter(r["p_brand"] for r in part)
    got = {r["p_partkey"]: r["n"] for r in tables.QUERIES["stem_lookup_join"](spark, sf_dir).collect()}
    assert got == {r["p_partkey"]: n[r["p_brand"]] for r in part}


def test_gaps_of_whole_tables(spark, sf_dir):
    stems = {str(int(r["s_acctbal"])) for r in rows(spark, sf_dir, "supplier")}
    keys = [str(r["c_custkey"]) for r in rows(spark, sf_dir, "customer")]
    bare = {k for k in keys if not any(s in k or k in s for s in stems)}
    assert 0 < len(bare) < len(keys)
    days = {str(r["o_orderkey"]): (str(r["o_custkey"]), r["o_orderdate"].day) for r in rows(spark, sf_dir, "orders")}
    want = {(path, key, "medium" if day < 10 else "high") for key, (path, day) in days.items() if day >= 5 and path in bare}
    assert {tuple(r) for r in tables.QUERIES["coverage_gap_anti"](spark, sf_dir).collect()} == want
