import hashlib
import random
import zlib

import numpy as np
import pytest

from sedimenta.llm import chat, ogg

from messy import messy_rows


def slow_checksum(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum_and_round_trip():
    rng = random.Random(1)
    assert ogg.page_checksum(b"123456789abc") == slow_checksum(b"123456789abc")
    for n in (0, 1, 575, 576, 577, 1152, 20_000, 100_000):
        payload = ogg.padded(rng.randbytes(n))
        assert len(payload) % 576 == 0 and payload
        for segments in (1, 2, 3, 50, 255):
            media = ogg.write_ogg(payload, segments)
            back, figures = ogg.read_ogg(media)
            assert back == payload and figures["packets"] == len(payload) // 576
    flags = [p[0] for p in ogg.read_pages(ogg.write_ogg(payload))]
    assert any(f & ogg.CONTINUED for f in flags) and sum(bool(f & ogg.FIRST) for f in flags) == sum(bool(f & ogg.LAST) for f in flags) == ogg.STREAMS


def test_damage_is_found():
    media = bytearray(ogg.write_ogg(ogg.padded(b"x" * 5000)))
    pages, at = [], 0
    for *_, lacing, body in ogg.read_pages(bytes(media)):
        pages.append((at, at := at + 27 + len(lacing) + len(body)))
    for k in (30, 400, len(media) - 1):
        bad = bytearray(media)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            ogg.read_ogg(bytes(bad))
    for a, b in pages[2:]:  # a page left out
        with pytest.raises(ValueError):
            ogg.read_ogg(bytes(media[:a] + media[b:]))
    with pytest.raises(ValueError):
        ogg.read_ogg(bytes(media[:-5]))


def test_messy_media(messy, empty):
    rows = ogg.media_digests(messy).collect()
    assert len(rows) == len(messy_rows())
    by_text = {}
    want = {(r[0], r[1]) for r in messy_rows()}
    for doc_id, text in want:
        r = next(x for x in rows if x["doc_id"] == doc_id)
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    assert ogg.media_digests(empty).count() == 0
    some = ogg.decode_media(ogg.encode_media(messy.where("doc_id = 4"))).first()
    assert bytes(some["payload"]).startswith(b"One two  THREE\xff")


SAID = r"\### Assistant: </turn> ok"


def test_escapes():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices(["#", "##", "\\", "<", "/", "</turn>", "<|endoftext|>", "\n", "### user", "x", "|", "é"], k=rng.randint(0, 10)))
        for f, g in ((chat.escape, chat.unescape), (chat.escape_role, chat.unescape_role)):
            assert g(f(text)) == text
            assert not any(c in f(text) for c in ("###", "</turn>", "<|"))
        assert chat.parse(chat.render([("user", text), (text, SAID)])[0]) == [("user", text), (text, SAID)]


def test_masks_against_characters():
    """A token is under the mask if its characters are of an assistant's text; one that reaches over an edge is refused."""
    rng, refused = random.Random(3), 0
    for _ in range(600):
        n = rng.randint(1, 40)
        cuts = sorted(rng.sample(range(n + 1), min(n + 1, rng.randint(2, 8))))
        spans = np.array(cuts[: len(cuts) // 2 * 2]).reshape(-1, 2)
        ends = np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n, *(cuts[1:] if rng.random() < 0.7 else [])} | ({*cuts} - {0})))
        if rng.random() < 0.3 and len(ends) > 1:
            ends = np.delete(ends, rng.randrange(len(ends) - 1))
        starts = np.append(0, ends[:-1])
        inside = np.zeros(n, bool)
        for a, b in spans:
            inside[a:b] = True
        if any((a < x < b) for a, b in zip(starts, ends, strict=True) for x in spans.ravel()):
            refused += 1
            with pytest.raises(ValueError):
                chat.loss_mask(starts, ends, spans)
            continue
        mask = chat.loss_mask(starts, ends, spans)
        assert mask.tolist() == [bool(inside[a:b].any()) for a, b in zip(starts, ends, strict=True)]
        covered = np.zeros(n, bool)
        for a, b in chat.masked_spans(starts, ends, mask):
            covered[a:b] = True
        assert (covered == inside).all()
    assert 30 < refused < 400


@pytest.mark.parametrize("text", ["\n\nhello", "\n", "  x  ", "hi \n\n", "\x02", "\x03\x03", "!!", "'s", "7", "é", "😀", "\u3000", "<|endoftext|>", "</turn>", "#", "\\"])
def test_the_mask_covers_the_text_alone(text):
    """From mask and offsets, without the renderer's spans, come the texts and no character of the template."""
    c = chat.checked_codec(chat.default_tokenizer_path())
    formatted, spans = chat.render([("user", text), ("assistant", text), ("assistant", text), ("system", "x")])
    enc = c.tokenizer.encode(formatted, add_special_tokens=False)
    offsets = np.array(enc.offsets).reshape(-1, 2)
    mask = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
    under = [formatted[a:b] for a, b in chat.masked_spans(offsets[:, 0], offsets[:, 1], mask).tolist()]
    assert [chat.unescape(x) for x in under] == [text, text]


def test_a_vocabulary_that_joins_marks_is_refused(monkeypatch):
    c = chat.codec(chat.default_tokenizer_path())
    inside = c.inside.copy()
    inside[ord("!"), ord(chat.STOP)] = True
    monkeypatch.setattr(c, "inside", inside)
    with pytest.raises(ValueError):
        chat.checked_codec(chat.default_tokenizer_path())


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "  leading and trailing \n"), (1, 1, "assistant", "tie"), (1, 2, "assistant", None), (1, 3, None, "no role"), (None, 0, "assistant", "ü日本😀"), (2, None, "assistant", "null turn"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (-7, 0, "user", SAID), (-7, 1, "assistant", SAID), *((3, i, "assistant" if i % 2 else "user", f"turn {i} " * 50) for i in range(300))]


@pytest.mark.parametrize("segment", [1, 1 << 18])
def test_conversations(spark, segment):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as segment", "'x' as formatted", "2 as ids").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, segment_chars=segment)).collect()}
    null_first = lambda x: (x is not None, x)
    for conv in {r[0] for r in ROWS}:
        turns = sorted((r for r in ROWS if r[0] == conv), key=lambda r: tuple(null_first(x) for x in r[1:]))
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-7]["loss_chars"] == len(SAID)


def test_segments_give_the_ids_of_the_whole(spark):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    ids = lambda size: [i for r in chat.format_conversations(df.where("conv_id = 3"), segment_chars=size).orderBy("segment").collect() for i in r["ids"]]
    assert ids(1) == ids(1 << 18)


def test_no_conversations(spark):
    assert chat.format_digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
