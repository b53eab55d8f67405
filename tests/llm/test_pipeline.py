"""Each stage against a plain version, on what the stage before it kept."""

import brute

import corpus_pipeline as P
from sedimenta.llm.common import materialize, read


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    kept = [docs]
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        kept.append(docs)
    for df in kept[1:5]:
        assert df.columns == kept[0].columns
    start, clean, single, unique, fair, last = kept
    assert {r["doc_id"] for r in clean.collect()} <= {r["doc_id"] for r in start.collect()} and clean.count() >= 0.8 * start.count()
    near = brute.near_duplicates(pairs(clean))
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in near.items() if i == c}
    assert dict(pairs(unique)) == {i: k.decode(errors="ignore") for i, _, _, _, k in brute.removal(pairs(single), P.PASSAGE_BYTES, P.PASSAGE_WORDS)}
    assert all(r["n_chars"] == len(r["text"]) for r in unique.collect())
    items = [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()]
    assert sorted(pairs(fair)) == sorted((i, t) for (i, t), r in zip(pairs(unique), brute.decontamination(pairs(unique), items, items_from=1), strict=True) if not r[-1])
    assert [r["doc_id"] for r in last.orderBy("doc_id").collect()] == sorted(r["doc_id"] for r in fair.collect())
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(map(tuple, last.collect()))


def test_messy_and_empty_documents(spark, sf_dir, messy, empty):
    for docs in (messy, empty):
        for name, stage in P.STAGES:
            n = docs.count()
            docs = materialize(stage(spark, docs, sf_dir), name)
            assert docs.count() <= n
