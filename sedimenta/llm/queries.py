"""The queries of this subpackage, with production parameters over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import bpe, chat, decontam, langid, minhash, ogg, suffix_dedup, token_counts, toxicity, warc
from sedimenta.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(read(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digests(read(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_warc_revisits, op3_repeated_substrings, op4_bpe_round_trip, op5_near_duplicates, op6_chat_masks, op7_ogg_media, op8_language, op9_toxicity, op10_token_counts)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = f"translate(text, '{_UPPER}', '{_LOWER}')"
_WORDS = f"coalesce(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT item, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT r, s, n, item FROM dw JOIN win USING (k, n)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT page_id, strlen(h) AS n, array_to_string(list_transform(string_split(x, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INT) * (1 << CAST(5 - j AS INT)))) AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
isl AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM rep),
grp AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM isl),
sp AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS b FROM grp GROUP BY ALL),
gap AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM sp),
cut AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last FROM sp GROUP BY 1),
s2 AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 500)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 249)) AS i FROM d WHERE n >= 250)),
rep2 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM s2) WHERE c > 1),
isl2 AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 250 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS fresh FROM rep2),
grp2 AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM isl2),
told AS (SELECT doc_id, count(*) AS n_passages, CAST(sum(b - a) AS BIGINT) AS n_passage_bytes FROM (SELECT doc_id, g, min(i) AS a, max(i) + 250 AS b FROM grp2 GROUP BY ALL) GROUP BY 1),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head FROM gap g JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256,
coalesce(n_passages, 0) AS n_passages, coalesce(n_passage_bytes, 0) AS n_passage_bytes
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOW}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + n - 1), ' ') || '/' || n AS k FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY 1),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM pr JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * pr.c >= 75 * (x.c + y.c - pr.c)),
nb AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT walk.a, nb.b FROM walk JOIN nb ON nb.a = walk.b)
SELECT doc_id, coalesce(c, 0) AS n_shingles, least_id AS component_id, doc_id = least_id AS kept FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM walk GROUP BY 1) USING (doc_id)"""

_ESCAPED = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '##', '#\#'), '</', '<\/'), '<|', '<\|')"

OP6 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(16 + length(replace({_ESCAPED.format('role')}, chr(10), '\n')) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """BPE, media, learned scores and lengths in tokens have no form in SQL; the tests hold them against plain versions."""
    return {"op1_decontamination": OP1, "op2_warc_revisits": OP2, "op3_repeated_substrings": OP3, "op5_near_duplicates": OP5, "op6_chat_masks": OP6}
