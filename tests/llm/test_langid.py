import itertools
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from messy import messy_rows

from sedimenta.llm import langid, queries


def slow_total(word, index, p):
    """The sum over all segmentations, by trying each."""
    word, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        product = 1.0
        for a, b in itertools.pairwise(at):
            k = index.get(word[a:b], -1)
            product *= p[k] if k >= 0 else p[-1] if b == a + 1 else 0.0
        total += product
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "bc", "c", "abc", "▁", "a", "cc"]
    index = {p: i for i, p in enumerate(pieces)}
    p = np.append(np.linspace(0.05, 0.2, len(pieces)), 1e-3)
    words = ["a", "ab", "abc", "abcc", "xab", "bcbc", "cab", "é"]
    lattice = langid.Lattice(words, langid.Trie(pieces))
    got = lattice.totals(p[:, None])[:, 0]
    want = [slow_total(w, index, p) for w in words]
    assert np.allclose(np.exp(got), want)
    # Backward gives the same totals, and so does scoring in blocks of any size.
    assert np.allclose(np.exp(lattice.backward(p[:, None])[:, 0, 0]), want)
    for block in (1, 2, 3, 256):
        assert np.allclose(np.exp(langid.log_totals(words, langid.Trie(pieces), p[:, None], block)[:, 0]), want)


def test_fit_makes_the_sample_likelier():
    pieces = ["▁ab", "ab", "▁", "a", "b", "▁a", "ba"]
    counts = {"x": Counter({"abab": 10_000, "ab": 5000}), "y": Counter({"baba": 10_000, "ba": 3000})}
    _, one = langid.fit(counts, pieces, 1)
    langs, five = langid.fit(counts, pieces, 5)
    assert langs == ["x", "y"]
    index = {p: i for i, p in enumerate(pieces)}
    for k, lang in enumerate(langs):
        like = lambda t: sum(n * math.log(slow_total(w, index, t[:, k])) for w, n in counts[lang].items())  # noqa: E731, B023
        assert like(five) > like(one)


def test_held_out_accuracy(spark, sf_dir):
    rows = queries.op8_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_not_seen(spark, small):
    """Changed labels, ids and sources of the held-out fold change nothing."""
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    other = small.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    a, b = langid.train(small), langid.train(other)
    assert a[:2] == b[:2] and (a[2] == b[2]).all()


def test_messy_table(messy, empty, small):
    model = langid.train(small)
    got = langid.identify(messy, model).collect()
    assert len(got) == len(messy_rows())
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and by[0]["score"] == 0
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (0, 1, 2)) for r in got)
    assert by[None]["held_out"] is False and by[None]["lang_pred"] == by[5]["lang_pred"]
    assert langid.identify(empty, model).count() == 0
    none = langid.train(empty)
    assert none[1] == [] and {r["lang_pred"] for r in langid.identify(messy, none).collect()} == {"und"}
    assert langid.train(messy)[1] == ["en"]  # null labels are not learned


def test_small_memo_gives_the_same(small):
    pieces, langs, table = langid.train(small)
    texts = [r["text"] for r in small.limit(20).collect()]
    assert langid.Scorer(pieces, langs, table, 50).predict(texts) == langid.Scorer(pieces, langs, table).predict(texts)


def exact_log_total(word, index, p):
    """The same sum for words of any length, place by place, in fractions."""
    word, a = "▁" + word, [Fraction(1)]
    for j in range(1, len(word) + 1):
        a.append(Fraction(0))
        for i in range(max(0, j - 20), j):
            k = index.get(word[i:j], -1)
            if k >= 0 or j == i + 1:
                a[j] += a[i] * Fraction(float(p[k if k >= 0 else -1]))
        top = a[j].numerator.bit_length() - 400  # fractions of 400 bits are enough
        if top > 0:
            a[j] = Fraction(a[j].numerator >> top, 1) * 2**top / a[j].denominator
    return math.log(a[-1].numerator) - math.log(a[-1].denominator)


@pytest.mark.parametrize("length", [1, 15, 41, 42, 500, 1500])
def test_words_of_any_length(length):
    """No word is cut: the score is the sum over all segmentations of the whole, and no piece has a length of its own."""
    pieces = sorted({"▁a", "▁ab", "b", "bc", "c", "abc", "▁", "a", "cc", "abcabcabcabcabcabc"})
    index = {x: i for i, x in enumerate(pieces)}
    p = np.append(np.linspace(0.01, 0.2, len(pieces)), langid.FLOOR)
    rng = np.random.default_rng(length)
    words = ["".join(rng.choice(list("abcx"), length)), ("abc" * length)[:length], "y" * length]
    want = [exact_log_total(w, index, p) for w in words]
    assert np.allclose(langid.log_totals([*words, "a"], langid.Trie(pieces), p[:, None])[:3, 0], want, rtol=1e-9)
    assert np.allclose(langid.Lattice(words, langid.Trie(pieces)).totals(p[:, None])[:, 0], want, rtol=1e-9)
    scorer = langid.Scorer(pieces, ["a", "b"], np.stack([p, p], 1))
    assert np.allclose(scorer.of_batch([words[0]])[0], want[0], rtol=1e-9)


def test_sample_is_bounded(spark):
    """A doc_id, a text or a language that fills the table doesn't fill the sample; a language of long texts only is learned."""
    rows = [(1, f"text number {chr(97 + i % 26)}{'b' * (i // 26)}", "en") for i in range(3000)] + [(1, "one copy", "de")] * 3000
    rows += [(i + 10, "langer satz " * 6000 + chr(97 + i), "fr") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = langid.training_rows(docs, rows=100).collect()
    n = Counter(r["lang"] for r in got)
    assert n["en"] == 100 and n["de"] == 1 and n["fr"] >= 1
    assert Counter(r["lang"] for r in langid.training_rows(docs, rows=100, chars=1).collect()) == {"en": 1, "de": 1, "fr": 1}
    assert {r["lang"] for r in langid.training_rows(docs, languages=2).collect()} == {"de", "en"}
    ids = docs.selectExpr("concat('id-', doc_id) as doc_id", "text", "lang")
    assert langid.identify(ids, langid.train(ids)).where("doc_id = 'id-1'").count() == 6000
