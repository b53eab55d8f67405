import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sedimenta.llm import bpe, token_counts

from messy import messy_rows, texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer_path())


def test_fragments_give_the_ids_of_the_whole(library):
    codec, rng = bpe.ForcedBoundaryCodec(bpe.default_tokenizer_path(), memo_fragments=50), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "é", "à", "\xa0", "　", "!", "1", "\x1c", "\x85", "?'re", "日本", "😀", "\r\n", "​", "ll", "'ll", "\v", "ß"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert codec.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_cuts_are_in_no_token():
    codec = bpe.ForcedBoundaryCodec(bpe.default_tokenizer_path())
    cuts = codec.certain_cuts()
    assert (ord("e"), ord(" ")) in cuts
    assert not any(bytes(c) in t for c in cuts[:200] for t in codec.token_bytes)
    assert "".join(codec.stretches("x  y\nz  w ")) == "x  y\nz  w "


def test_encoding_goes_through_forced_cuts(library, monkeypatch):
    """No merged fragment has a pair of bytes inside that no token has, pieces with such pairs are cut there, and a codec that
    takes every pair to be inside a token cuts none and gives the same ids."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzqqqxxxjjjéß日 本#$%&'0189 ", k=200)) for _ in range(200)]
    texts += ["".join(rng.choices("bcdfghjklmnpqrstvwxzé!'# ", k=200)) for _ in range(50)]
    codec, seen = bpe.ForcedBoundaryCodec(bpe.default_tokenizer_path()), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda x: (seen.append(x), merge(x))[1])
    got = codec.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    inside = {t[i : i + 2] for t in codec.token_bytes for i in range(len(t) - 1)}
    assert seen and all(x[i : i + 2] in inside for x in seen for i in range(len(x) - 1))
    alphabet = bpe.byte_alphabet()
    steps = list(dict.fromkeys(x for t in texts for x in codec.stretches(t)))
    pieces = [bytes(alphabet[c] for c in p) for x in steps for p, _ in library.pre_tokenizer.pre_tokenize_str(x)]
    pairs = sum(p[i : i + 2] not in inside for p in pieces for i in range(len(p) - 1))
    assert codec.forced == pairs > 1000
    none = bpe.ForcedBoundaryCodec(bpe.default_tokenizer_path())
    none.inside[:] = True
    assert none.encode_batch(texts) == got and none.forced == 0


def test_messy_table(messy, library):
    rows = bpe.encode_digests(messy).collect()
    want = []
    for r in messy_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_tables_and_back(messy, empty):
    back = {r["row_key"]: r["text"] for r in bpe.decode_ids(bpe.encode_texts(messy.where("doc_id is not null"))).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts()))
    assert bpe.encode_digests(empty).count() == 0


def test_length_histogram(messy, empty, library):
    lengths = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in messy_rows())
    sums = token_counts.suffix_sums(token_counts.length_histogram(messy)).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["total_docs"] == len(lengths) and r["total_tokens"] == sum(lengths)
    for limit in (0, 1, 7, 100, 5000, 10**9):
        assert token_counts.truncated_total(sums, limit).first()["total"] == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 1.0):
        n = token_counts.length_quantile(sums, q).first()["n_tokens"]
        assert sum(x <= n for x in lengths) >= q * len(lengths) > sum(x < n for x in lengths)
    none = token_counts.suffix_sums(token_counts.length_histogram(empty))
    assert none.count() == 0 and token_counts.truncated_total(none, 5).first()["total"] == 0
    assert token_counts.length_quantile(none, 0.5).first()["n_tokens"] is None
