import base64
import hashlib

from sedimenta.llm import warc

ROWS = [(5, "http://a/1", "<p>same</p>"), (2, "http://a/%20x", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://b\r\nX: y", ""), (3, "u", None), (4, "u", "other é"), (None, "u", "other é"), (None, "v", "other é"), (7, "u", "x" * 300_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as archive", "2 as chunk", "'d' as digest", "'e' as data").repartition(3)


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least:
            first[p] = min(first.get(p, (True, 0)), (i is None, i or 0))
    return first


def test_revisits(spark):
    got = warc.archive_pages(pages(spark)).collect()
    first = expected(ROWS)
    assert len(got) == len(ROWS)
    for i, _, html in ROWS[:6] + ROWS[8:]:
        r = next(x for x in got if x["page_id"] == i)
        p = (html or "").encode()
        original = first[p] == (False, i)
        assert r["payload_bytes"] == len(p) and r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if original else ("revisit", first[p][1]))
    assert [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None] == [("revisit", 4)] * 2


def test_short_payloads_and_hot_digests(spark):
    rows = [(i, "u", "hot" if i % 3 else f"page {i}") for i in range(60)]
    headers = warc.read_headers(warc.write_archives(pages(spark, rows)))
    for share in (0.0, 0.5, 2.0):  # all digests hot, some, none
        got = warc.resolve_revisits(headers, hot_share=share).collect()
        assert sum(r["original"] is not None for r in got) == sum(bool(i % 3) for i in range(60)) - 1
        assert {r["original"]["page_id"] for r in got if r["original"]} == {1}
    assert all(r["original"] is None for r in warc.resolve_revisits(headers, min_bytes=8).collect())


def test_archives_are_whole_files(spark, tmp_path):
    raw = warc.write_archives(pages(spark)).cache()
    made = warc.deduplicate_archives(raw, warc.resolve_revisits(warc.read_headers(raw)))
    out = warc.export_archives(made, f"file://{tmp_path}/out").collect()
    records = []
    for r in out:
        data = (tmp_path / "out" / f"{r['archive']}.warc.gz").read_bytes()
        assert len(data) == r["bytes"]
        records += warc.read_records(data)
    assert len(records) == len(ROWS)
    revisits = [h for h, _ in records if h["WARC-Type"] == "revisit"]
    ids = {h["WARC-Record-ID"] for h, _ in records}
    assert len(ids) == len(ROWS) and all(h["WARC-Refers-To"] in ids and h["WARC-Profile"] == warc.PROFILE for h in revisits)
    assert all(b.endswith(b"\r\n\r\n") for h, b in records if h["WARC-Type"] == "revisit")
    assert any(h["WARC-Target-URI"] == "http://b%0D%0AX: y" for h, _ in records)


def test_no_pages(spark):
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_urls_come_back_whole(spark):
    urls = [None, "", "http://a/%0D%0A", "http://a/\r\n", " b ", "c: d", "é\t"]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    got = warc.read_headers(warc.write_archives(pages(spark, rows))).collect()
    assert {r["page_id"]: r["uri"] for r in got} == dict(enumerate(urls))


def test_a_long_archive_is_gone_through_once():
    """Four times the records take about four times as long, and a record that is cut off is told."""
    import time

    record = warc.write_record([("WARC-Type", "response")], warc.http_block(b"x" * 900))
    took = []
    for n in (4000, 16_000):
        began = time.time()
        assert sum(1 for _ in warc.read_records(record * n)) == n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1
    for bad in (record[:-3], record * 2 + record[: len(record) // 2]):
        try:
            list(warc.read_records(bad))
        except ValueError as e:
            assert "cut off" in str(e)
        else:
            raise AssertionError
