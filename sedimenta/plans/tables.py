"""Queries of single operators over the driver's tables: documents stand for source files, events for calls, and so on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import rules as R
from sedimenta.functions import text as X
from sedimenta.operators import flows, merge, metrics, packing, retrieval, scan, telemetry
from sedimenta.sources import files as S
from sedimenta.workers import reach

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files."""
    return table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def item_order():
    """One number by which items of an order are ordered: line numbers repeat."""
    return F.col("l_linenumber") * F.lit(10_000_000_000_000) + F.col("l_partkey") * 100_000_000 + F.floor("l_extendedprice")


#: Text as lines in DuckDB: the end of a text begins no further line.
LINES = "string_split(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), chr(10))"
_L = LINES.format("text")
DOC_LINES = f"SELECT doc_id, source, unnest(generate_series(1, n)) AS line, unnest(list_slice(l, 1, n)) AS t FROM (SELECT doc_id, source, l, CASE WHEN l[len(l)] = '' THEN len(l) - 1 ELSE len(l) END AS n FROM (SELECT doc_id, source, {_L} AS l FROM documents WHERE text IS NOT NULL)) WHERE n > 0"
IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
TOKEN = r"""(?i)(bearer|token)\s*[=:]\s*['"][A-Za-z0-9._\-]{16,}"""
SECRET_SQL = [
    ("hardcoded_password", "critical", None),
    *((r[0], r[1], r[3].replace("'", "''")) for r in R.SECRETS[1:]),
]
_PASSWORD = r"""(regexp_matches(t, '(?i)(password|passwd|pwd|secret)\s*=\s*[''"].{4,}') AND NOT regexp_matches(t, '(?i)(password|passwd|pwd|secret)\s*=\s*[''"].*\$\{'))"""
SECRET_CASE = "CASE WHEN " + _PASSWORD + " THEN 'hardcoded_password' " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{r}'" for r, _, p in SECRET_SQL[1:]) + " END"
SEVERITY_CASE = "CASE " + " ".join(f"WHEN rule_id = '{r}' THEN '{s}'" for r, s, _ in SECRET_SQL) + " END"
SECRET_FINDINGS = f"SELECT *, {SEVERITY_CASE} AS severity FROM (SELECT doc_id, line, t, {SECRET_CASE} AS rule_id FROM ({DOC_LINES}))  WHERE rule_id IS NOT NULL"


def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first secret rule that each line of documents meets."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return scan.secret_lines(files).select("doc_id", "line", F.col("text").alias("t"), "f.*")


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS INT) AS loc FROM documents")
def loc_per_document(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.lines_of_code(F.col("text")).alias("loc"))


@query("SELECT page_id, url FROM pages WHERE NOT (contains('/' || url, '/en/') OR starts_with(url, 'src/en')) AND NOT list_has_any(string_split(url, '/'), ['build', 'target', 'node_modules', '.git', '.gradle', 'gradle'])")
def path_segment_filter(spark, sf_dir):
    return pages(spark, sf_dir).where(~S.is_test(F.col("url"), "en", "src/en") & ~S.is_excluded(F.col("url"))).select("page_id", "url")


@query(
    "SELECT doc_id, CAST(line AS INT) AS line, rule_id FROM (SELECT doc_id, line, unnest(list_filter([CASE WHEN regexp_matches(t, '(?i)//\\s*(TODO|FIXME|HACK|XXX|TEMP)[\\s:]') THEN 'todo_comment' END, CASE WHEN regexp_matches(t, 'https?://\\S+') THEN 'url' END, CASE WHEN regexp_matches(t, '"
    + IP
    + "') THEN 'ip' END, CASE WHEN regexp_matches(t, '(?i)license') THEN 'license' END], lambda x: x IS NOT NULL)) AS rule_id FROM ("
    + DOC_LINES
    + "))"
)
def line_rule_findings(spark, sf_dir):
    rules = (R.LINE_RULES[-1], R.LineRule("url", "smell", "low", "", r"https?://\S+"), R.LineRule("ip", "secret", "low", "", R.SECRETS[9][3]), R.LineRule("license", "smell", "info", "", "(?i)license"))
    return scan.line_findings(documents(spark, sf_dir), rules).select(F.col("path").cast("bigint").alias("doc_id"), "line", "rule_id")


@query(f"SELECT doc_id, CAST(line AS INT) AS line, rule_id, severity, CASE WHEN length(t) <= 8 THEN '***' ELSE left(t, 4) || '***' || right(t, 2) END AS redacted FROM ({SECRET_FINDINGS})")
def first_match_secret(spark, sf_dir):
    return document_secrets(spark, sf_dir).select("doc_id", "line", "rule_id", "severity", X.redact(F.col("t")).alias("redacted"))


@query(
    "SELECT doc_id, CAST(line AS INT) AS line FROM (SELECT doc_id, line, t, lead(t, 1) OVER w AS a, lead(t, 2) OVER w AS b FROM ("
    + DOC_LINES
    + ") WINDOW w AS (PARTITION BY doc_id ORDER BY line)) WHERE contains(t, 'the ') AND regexp_matches(concat_ws(' ', t, a, b), 'and .* the [a-z]+\\. [A-Z]')"
)
def adjacent_line_lookahead(spark, sf_dir):
    lines = scan.file_lines(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")))
    return lines.where(F.contains("text", F.lit("the ")) & F.col("block").rlike(r"and .* the [a-z]+\. [A-Z]")).select("doc_id", "line")


@query(f"SELECT s.severity, CAST(s.rank AS INT) AS rank, coalesce(n, 0) AS n FROM (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('info', 4)) s(severity, rank) LEFT JOIN (SELECT severity, count(*) AS n FROM ({SECRET_FINDINGS}) GROUP BY 1) f USING (severity)")
def finding_severity_summary(spark, sf_dir):
    return scan.severity_summary(document_secrets(spark, sf_dir))


@query(f"SELECT rule_id, count(*) AS n FROM ({SECRET_FINDINGS}) GROUP BY 1")
def rule_counts_desc(spark, sf_dir):
    return scan.counts_desc(document_secrets(spark, sf_dir), "rule_id", "rule_ord")


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS VARCHAR) AS snippet, CASE WHEN day(o_orderdate) < 10 THEN 'medium' ELSE 'high' END AS severity FROM orders JOIN customer c ON c_custkey = o_custkey WHERE day(o_orderdate) >= 5 AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT CAST(CAST(trunc(s_acctbal) AS BIGINT) AS VARCHAR) AS stem FROM supplier) s WHERE contains(CAST(c_custkey AS VARCHAR), stem) OR contains(stem, CAST(c_custkey AS VARCHAR)))"
)
def coverage_gap_anti(spark, sf_dir):
    """Customers as classes, their orders as methods with the day as complexity, balances of suppliers as stems of tests."""
    key = lambda c: F.col(c).cast("string")
    classes = table(spark, sf_dir, "customer").select(key("c_custkey").alias("file_path"), F.lit(0).alias("class_ord"), key("c_custkey").alias("name"))
    methods = table(spark, sf_dir, "orders").select(key("o_custkey").alias("file_path"), F.lit(0).alias("class_ord"), key("o_orderkey").alias("signature"), F.dayofmonth("o_orderdate").alias("cyclomatic_complexity"))
    tests = table(spark, sf_dir, "supplier").select(F.concat(F.col("s_acctbal").cast("bigint").cast("string"), F.lit("Test.java")).alias("path"))
    return scan.coverage_gaps(classes, methods, tests).select("path", "snippet", "severity")


@query(
    "SELECT role, count(*) AS n FROM (SELECT CASE WHEN p_brand = 'Brand#1' OR ends_with(p_brand, '1') THEN 'service' WHEN ends_with(p_brand, '2') THEN 'repository' WHEN ends_with(p_type, 'Repository') THEN 'repository' WHEN contains(p_name, 'Dto') THEN 'dto' WHEN contains(p_name, 'Token') OR contains(p_name, 'Auth') OR contains(p_name, 'Jwt') OR contains(p_name, 'Security') THEN 'security' WHEN contains(p_name, 'Config') THEN 'config' ELSE 'model' END AS role FROM part) GROUP BY 1"
)
def role_case_priority(spark, sf_dir):
    brand = F.col("p_brand")
    annos = F.when(F.endswith(brand, F.lit("1")), F.array(F.lit("Other"), F.lit("Service"))).when(F.endswith(brand, F.lit("2")), F.array(F.lit("Repository"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", X.role_of(annos, F.col("p_name"), F.lit("class")).alias("role"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).orderBy(F.desc("n"), "first").drop("first")


_PACKAGE = "replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/', '.')"


@query(
    f"SELECT module, count(*) AS n FROM (SELECT CASE WHEN list_contains(p, 'en') THEN 'en' WHEN list_position(p, 'm') > 0 THEN list_aggregate(list_slice(p, list_position(p, 'm'), list_position(p, 'm') + 1), 'string_agg', '.') WHEN list_contains(p, 'com') THEN 'com' ELSE k END AS module FROM (SELECT string_split({_PACKAGE}, '.') AS p, {_PACKAGE} AS k FROM pages)) GROUP BY 1"
)
def module_from_path(spark, sf_dir):
    package = F.replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), F.lit("/"), F.lit("."))
    parts = F.split(package, r"\.")
    at = F.array_position(parts, "m").cast("int")
    module = F.when(F.array_contains(parts, "en"), "en").when(at > 0, F.array_join(F.slice(parts, at, 2), ".")).when(F.array_contains(parts, "com"), "com").otherwise(package)
    return pages(spark, sf_dir).groupBy(module.alias("module")).agg(F.count("*").alias("n"))


@query(
    "SELECT package, CASE WHEN i > 0 THEN list_aggregate(list_slice(p, i, i + 1), 'string_agg', '.') WHEN list_contains(p, 'common') THEN 'common' WHEN list_contains(p, 'config') THEN 'config' WHEN package = '' THEN '(default)' ELSE package END AS module FROM (SELECT package, string_split(package, '.') AS p, list_position(string_split(package, '.'), 'services') AS i FROM (VALUES ('com.a.services.catalog.api'), ('com.a.services'), ('com.common.x'), ('a.config'), ('a.b'), ('')) t(package))"
)
def module_rules(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, ("com.a.services.catalog.api", "com.a.services", "com.common.x", "a.config", "a.b", "")))).alias("package"))
    return rows.select("package", X.module_of(F.col("package")).alias("module"))


@query(
    "SELECT page_id, '/' || a AS endpoint, CASE WHEN starts_with(a, '/') THEN a ELSE '/' || a END AS flow, trim('GET ' || CASE WHEN base <> '' THEN '/' || trim(base, '/') ELSE '' END || CASE WHEN path <> '' THEN '/' || trim(path, '/') ELSE '' END) AS http_endpoint FROM (SELECT page_id, base, path, list_aggregate(list_transform(list_filter([base, path], lambda x: x <> ''), lambda x: trim(x, '/')), 'string_agg', '/') AS a FROM (SELECT page_id, coalesce(regexp_extract(url, '^https?://[^/]+(/[a-z]+)', 1), '') AS base, coalesce(regexp_extract(url, '^https?://[^/]+/[a-z]+(/[^?#]*)', 1), '') AS path FROM pages)) WHERE a IS NOT NULL"
)
def endpoint_path_join(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "^https?://[^/]+(/[a-z]+)", 1).alias("base"), F.regexp_extract("url", "^https?://[^/]+/[a-z]+(/[^?#]*)", 1).alias("path"))
    rows = rows.where("base <> '' or path <> ''")
    b, p = F.col("base"), F.col("path")
    return rows.select("page_id", X.endpoint_path(b, p).alias("endpoint"), X.flow_path(b, p).alias("flow"), X.http_endpoint(F.lit("GET"), b, p).alias("http_endpoint"))


@query(
    "SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS files, count(*) FILTER (o_orderstatus = 'F') AS classes, count(*) FILTER (o_orderstatus = 'O') AS interfaces, count(*) FILTER (o_orderstatus = 'P') AS enums, (SELECT count(*) FROM lineitem) AS methods, (SELECT CAST(sum(q) AS BIGINT) FROM (SELECT max_by(CAST(l_quantity AS BIGINT), (l_linenumber * 10000000000000 + l_partkey * 100000000 + CAST(floor(l_extendedprice) AS BIGINT))) AS q FROM lineitem GROUP BY l_orderkey)) AS lines_of_code FROM orders"
)
def totals_conditional(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    kinds = orders.agg(*(F.count_if(F.col("o_orderstatus") == k).alias(n) for k, n in (("F", "classes"), ("O", "interfaces"), ("P", "enums"))))
    per = items.groupBy("l_orderkey").agg(F.max_by(F.col("l_quantity").cast("bigint"), item_order()).alias("q"), F.count("*").alias("m"))
    rest = per.agg(F.count("*").alias("files"), F.sum("m").alias("methods"), F.sum("q").alias("lines_of_code"))
    return kinds.crossJoin(rest)  # one row by one row


@query(
    "SELECT round(avg(cc), 2) AS average, max(cc) AS max, count(*) FILTER (cc > 10) AS methods_over_10, count(*) FILTER (cc <= 4) AS simple_1_4, count(*) FILTER (cc BETWEEN 5 AND 10) AS moderate_5_10, count(*) FILTER (cc > 10) AS complex_over_10 FROM (SELECT CAST(l_quantity AS INT) AS cc FROM lineitem)"
)
def cc_histogram(spark, sf_dir):
    return metrics.complexity_summary(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("cc")), "cc")


@query(
    "SELECT l_returnflag AS module, count(*) AS classes, CAST(sum(l_linenumber) AS BIGINT) AS methods, CAST(sum(CASE WHEN prev IS NULL OR prev <> l_returnflag THEN q ELSE 0 END) AS BIGINT) AS loc FROM (SELECT l_returnflag, l_linenumber, CAST(l_quantity AS BIGINT) AS q, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber * 10000000000000 + l_partkey * 100000000 + CAST(floor(l_extendedprice) AS BIGINT))) AS prev FROM lineitem) GROUP BY 1"
)
def module_stats_once_per_file(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    rows = item.select(F.col("l_returnflag").alias("module"), F.col("l_orderkey").alias("file_path"), item_order().alias("class_ord"), F.col("l_quantity").cast("bigint").alias("loc"), F.sequence(F.lit(1), "l_linenumber").alias("methods"))
    return metrics.module_stats(rows).withColumn("methods", F.col("methods").cast("bigint"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS cc FROM lineitem WHERE CAST(l_quantity AS INT) >= 5 ORDER BY cc DESC, l_orderkey, l_linenumber LIMIT 15")
def hotspot_top15(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("cc"))
    return metrics.hotspots(rows, "cc", ("l_orderkey", "l_linenumber"))


@query("SELECT doc_id, CAST(trunc(length(text) / 3.5) AS INT) + 1 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


PACKED = """WITH RECURSIVE items AS (SELECT source AS module, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, doc_id, least(CAST(trunc(length(text) / 3.5) AS INT) + 1, 8000) AS t FROM documents),
walk AS (SELECT module, i, doc_id, t, t AS held, 0 AS chunk FROM items WHERE i = 1 UNION ALL SELECT n.module, n.i, n.doc_id, n.t, CASE WHEN w.held + n.t > 8000 THEN n.t ELSE w.held + n.t END, CASE WHEN w.held + n.t > 8000 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN items n ON n.module = w.module AND n.i = w.i + 1)"""


@query(f"{PACKED} SELECT module, CAST(chunk AS INT) AS chunk, count(*) AS items, CAST(sum(t) AS BIGINT) AS tokens FROM walk GROUP BY ALL")
def chunk_pack_next_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), "doc_id", F.col("text").alias("digest"))
    return packing.pack(rows, 8000, ["doc_id"]).select("module", "chunk", "items", "tokens")


@query(f"{PACKED} SELECT module, CAST(chunk AS INT) AS chunk, CAST(half AS INT) AS half, count(*) AS items, min(doc_id) AS first FROM (SELECT module, chunk, doc_id, CASE WHEN n <= 1 OR r <= n // 2 THEN 0 ELSE 1 END AS half FROM (SELECT *, count(*) OVER (PARTITION BY module, chunk) AS n, row_number() OVER (PARTITION BY module, chunk ORDER BY doc_id) AS r FROM walk)) GROUP BY ALL")
def chunk_split_half(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), "doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))
    rows = packing.item_bins(docs, 8000, ["doc_id"])
    return packing.split_items(rows, ["doc_id"]).groupBy("module", "chunk", "half").agg(F.count("*").alias("items"), F.min("doc_id").alias("first"))


@query(
    "SELECT conv_id, 'FILE: ' || conv_id || chr(10) || 'CLASS: conv.' || conv_id || '  [role=' || (SELECT count(*) FROM conversations d WHERE d.conv_id = c.conv_id) || ']' || chr(10) || '  annotations: ' || string_agg('@' || role, ', ' ORDER BY turn) || chr(10) || '  injected deps: ' || (SELECT string_agg(role, ', ' ORDER BY role) FROM (SELECT DISTINCT role FROM conversations d WHERE d.conv_id = c.conv_id)) || chr(10) || '  javadoc: ' || left(string_agg(text, ' ' ORDER BY turn), 200) AS digest FROM conversations c GROUP BY conv_id"
)
def digest_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    name = F.col("conv_id").cast("string")
    card = packing.digest(name, F.lit("class"), F.concat(F.lit("conv."), name), F.size("x").cast("string"), annotations=F.col("x.role"), dependencies=F.col("x.role"), javadoc=F.array_join("x.text", " "))
    return listed.select("conv_id", card.alias("digest"))


_DESCRIBE = "CASE " + " ".join(f"WHEN starts_with(n, '{p}') THEN '{v} ' || trim(lower(regexp_replace(CASE WHEN substr(n, {len(p) + 1}) = '' THEN 'resource' ELSE substr(n, {len(p) + 1}) END, '([A-Z])', ' \\1', 'g'))) || '.'" for p, v in X.VERB_PREFIXES.items()) + " ELSE 'Implements `' || n || '` as declared: ' || sig || '.' END"


@query(f"SELECT p_partkey, {_DESCRIBE} AS description FROM (SELECT p_partkey, ['get','add','addressOf','totalCount','search','login','to','Size'][1 + p_partkey % 8] || replace(p_type, ' ', 'Of') AS n, 'int ' || p_size AS sig FROM part)")
def heuristic_description(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    starts = F.array(*map(F.lit, ("get", "add", "addressOf", "totalCount", "search", "login", "to", "Size")))
    name = F.concat(F.get(starts, (F.col("p_partkey") % 8).cast("int")), F.replace("p_type", F.lit(" "), F.lit("Of")))
    return part.select("p_partkey", X.describe_method(name, F.concat(F.lit("int "), F.col("p_size").cast("string"))).alias("description"))


@query("SELECT d.doc_id, left(sha256(concat_ws('||', source, CAST(d.doc_id AS VARCHAR))), 24) AS cache_key, CASE WHEN l.doc_id IS NULL THEN 'computed' ELSE 'cached' END AS status, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE CAST(l.quality AS VARCHAR) END AS payload FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def cache_key_hit_miss(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("id_text", F.col("doc_id").cast("string"))
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id", "source", "id_text"), "doc_id")
    cache = merge.with_key(labels, "source", "id_text").select("cache_key", F.col("quality").cast("string").alias("payload"))
    keyed = merge.with_key(docs.select("doc_id", "source", "id_text"), "source", "id_text")
    return merge.cached_map(keyed, cache, lambda rest: rest.withColumn("payload", F.lit("new"))).select("doc_id", "cache_key", "status", "payload")


@query("SELECT o.o_orderkey, coalesce(nullif(l.l_returnflag, 'N'), o.o_orderstatus) AS summary FROM orders o LEFT JOIN (SELECT l_orderkey, max_by(l_returnflag, (l_linenumber * 10000000000000 + l_partkey * 100000000 + CAST(floor(l_extendedprice) AS BIGINT))) AS l_returnflag FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def insight_merge_last_wins(spark, sf_dir):
    insights = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("summary"), item_order().alias("ord"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("javadoc"))
    return merge.merge_insights(orders, insights, "o_orderkey").select("o_orderkey", "summary")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS note FROM documents d LEFT JOIN labels l USING (doc_id)")
def insight_replay(spark, sf_dir):
    notes = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return merge.replay(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("note")), notes, "doc_id", "note").select("doc_id", "note")


@query("SELECT user_id, event_type, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins_dedupe(spark, sf_dir):
    return merge.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


def _chain(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    chain = flows.call_chain(
        t("customer").select("c_custkey", "c_mktsegment"),
        (t("orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey"),
        (items.select("l_orderkey", "l_partkey", "l_suppkey"), "o_orderkey", "l_orderkey"),
        (t("part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey"),
        (t("supplier").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey"),
        (t("nation").select("n_nationkey", "n_name"), "s_nationkey", "n_nationkey"),
    )
    return chain.groupBy("c_mktsegment", "p_brand", "n_name").agg(F.count("*").alias("n"))


@query(
    "SELECT c_mktsegment, p_brand, n_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL"
)
def call_chain_trace(spark, sf_dir):
    return _chain(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def _stem_lookup(part: DataFrame, tested: DataFrame) -> DataFrame:
    stems = tested.groupBy(X.repository_stem(F.concat("p_brand", F.lit("Repository"))).alias("stem")).agg(F.count("*").alias("n"))
    rows = part.select("p_partkey", X.repository_stem(F.concat("p_brand", F.lit("CustomRepositoryImpl"))).alias("stem"))
    return rows.join(stems, "stem", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "SELECT p_partkey, coalesce(t.n, 0) AS n FROM part p LEFT JOIN (SELECT lower(replace(replace(p_brand || 'Repository', 'Repository', ''), 'Impl', '')) AS stem, count(*) AS n FROM part GROUP BY 1) t ON t.stem = lower(replace(replace(replace(p_brand || 'CustomRepositoryImpl', 'Repository', ''), 'Impl', ''), 'Custom', ''))"
)
def stem_lookup_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return _stem_lookup(part, part)


@query("SELECT event_id, user_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) AS span_end FROM events")
def method_body_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return merge.spans_to_next(rows, "event_id", ["user_id"], F.lit(1_000_000_000).cast("bigint"), "span_end")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS doc FROM conversations")
def javadoc_carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("c"))
    return merge.carry_forward(rows, "c", ["conv_id"], ["turn"], "doc").drop("c")


_EVENTS = "SELECT event_id, event_type AS call_type, CAST(trunc(value) AS BIGINT) AS input_tokens, CAST(length(props) AS BIGINT) AS output_tokens, user_id % 3 = 0 AS cached FROM events"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as calls."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("call_type"), F.col("value").cast("bigint").alias("input_tokens"), F.length("props").cast("bigint").alias("output_tokens"), (F.col("user_id") % 3 == 0).alias("cached"))


@query(
    f"SELECT count(*) FILTER (NOT cached) AS api_calls, count(*) FILTER (NOT cached AND call_type <> 'heuristic') AS live_calls, count(*) FILTER (cached) AS cache_hits, CAST(coalesce(sum(input_tokens) FILTER (NOT cached), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(output_tokens) FILTER (NOT cached), 0) AS BIGINT) AS total_output_tokens, CAST(coalesce(sum(input_tokens + output_tokens) FILTER (NOT cached), 0) AS BIGINT) AS total_tokens, CAST(trunc(coalesce(avg(input_tokens + output_tokens) FILTER (NOT cached) * count(*) FILTER (cached), 0)) AS BIGINT) AS est_tokens_saved_by_cache, round(coalesce(sum(CASE WHEN cached THEN 0 ELSE (input_tokens * 3.0 + output_tokens * 15.0) / 1e6 END), 0)::DOUBLE, 6) AS total_cost_usd, round(100.0::DOUBLE * count(*) FILTER (cached) / greatest(count(*), 1), 6) AS hit_rate, round(coalesce(sum(input_tokens) FILTER (NOT cached), 0)::DOUBLE / greatest(count(*) FILTER (NOT cached), 1), 6) AS avg_input FROM ({_EVENTS})"
)
def telemetry_summary(spark, sf_dir):
    return telemetry.summary(ledger(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6)).withColumn("avg_input", F.round("avg_input", 6))


@query(
    f"SELECT call_type, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output, count(*) FILTER (cached) AS cached, round(sum(CASE WHEN cached THEN 0 ELSE (input_tokens * 3.0 + output_tokens * 15.0) / 1e6 END)::DOUBLE, 6) AS cost_usd FROM ({_EVENTS}) GROUP BY 1"
)
def telemetry_by_type(spark, sf_dir):
    return telemetry.by_type(ledger(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


@query(f"SELECT event_id, call_type, input_tokens + output_tokens AS total_tokens FROM ({_EVENTS}) ORDER BY event_id DESC LIMIT 100")
def telemetry_log_newest(spark, sf_dir):
    return telemetry.newest_first(telemetry.with_cost(ledger(spark, sf_dir)), "event_id", 100).select("event_id", "call_type", "total_tokens")


_TERMS = "list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda x: x <> '')"


@query(
    f"""WITH d AS (SELECT doc_id AS id, {_TERMS} AS w FROM documents), tf AS (SELECT id, t AS term, count(*) AS tf FROM (SELECT id, unnest(w) AS t FROM d) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / a))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d ON d.id = tf.id CROSS JOIN st GROUP BY ALL)
    SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""
)
def bm25_topk(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    places = F.floor(F.col("score") * 10_000 + 0.5) / 10_000  # as SQL rounds what has six places: by the double, not its digits
    return retrieval.bm25(nodes, asked).select("query_id", "id", "rank", places.alias("score"))


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


@query(f"SELECT id, round(score, 4) AS score FROM (SELECT e.vec_id AS id, {_DOT.format('e.embedding', 'q.embedding')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY round(score, 6) DESC, id LIMIT 5")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    rows = e.select(F.col("vec_id").alias("id"), "embedding").crossJoin(F.broadcast(one))  # one query vector
    return retrieval.vector_top_k(rows, F.col("q")).select("id", F.round("score", 4).alias("score"))


@query(f"SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_DOT.format('e.embedding', 'q.embedding')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.embedding', 'q.embedding')})), 4) AS score FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5")
def cosine_topk_batch(spark, sf_dir):
    """Every row whose id is divisible by 100 as a question, against all rows."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_top_k_batch(e, asked, 5, places=4)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    docs = t("documents").select(F.concat(F.lit("class::"), "doc_id").alias("id"), "text")
    sites = t("pages").select(F.concat(F.lit("module::"), "page_id").alias("id"), F.col("url").alias("text"))
    talks = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("text"))
    core = t("documents").agg(F.concat(F.lit("documents: "), F.count("*")).alias("text")).select(F.lit("stats::core").alias("id"), "text")
    return docs.unionByName(sites).unionByName(talks.select(F.concat(F.lit("endpoints::"), "conv_id").alias("id"), "text")).unionByName(core)


@query("SELECT 'class::' || doc_id AS id, text FROM documents UNION ALL SELECT 'module::' || page_id, url FROM pages UNION ALL SELECT 'endpoints::' || conv_id, string_agg(role, ',' ORDER BY turn) FROM conversations GROUP BY conv_id UNION ALL SELECT 'stats::core', 'documents: ' || count(*) FROM documents")
def node_union(spark, sf_dir):
    return _nodes(spark, sf_dir)


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(5)
    nodes = docs.select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("type"), F.col("lang")).alias("metadata"))
    rank = F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))  # five rows
    hits = docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"), rank.alias("rank"))
    return retrieval.extractive_answer(hits, nodes, "").select(F.substr("answer", F.lit(3)).alias("answer"))


@query("SELECT string_agg('### Source ' || r || ' (score ' || printf('%.3f', n / 1000.0) || ', ' || lang || ')' || chr(10) || t, chr(10) || chr(10) ORDER BY r) AS answer FROM (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, n_chars AS n, lang, text AS t FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5)")
def context_format(spark, sf_dir):
    return _context(spark, sf_dir)


@query("SELECT name, model FROM (VALUES ('', 'model-b'), ('model-a', 'model-a'), ('model-old', 'model-b'), ('model-a-20250514', 'model-a'), ('model-old-20240101', 'model-b'), ('other', 'other'), ('other-20250101', 'other-20250101')) t(name, model)")
def model_alias_resolve(spark, sf_dir):
    names = ("", "model-a", "model-old", "model-a-20250514", "model-old-20240101", "other", "other-20250101")
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))
    return rows.select("name", X.resolve_model(F.col("name"), ["model-a", "model-b"], {"model-old": "model-b"}, "model-b").alias("model"))


@query(
    "SELECT * FROM (VALUES ('404 not found', NULL, 'not_found', false, true), ('authentication_error', 0, 'auth', false, false), ('Rate_Limit', 0, 'rate_limit', false, false), ('Overloaded', 0, 'overloaded', false, false), ('x', 500, 'server', false, false), ('hit MAX_TOKENS', 0, 'other', true, false), ('field required: classes', 0, 'other', true, false), ('remote: permission denied', 0, 'other', false, true)) t(message, code, kind, truncated, refused)".replace("('404 not found', NULL, 'not_found', false, true)", "('404 not found', NULL, 'not_found', false, false)")
)
def error_classes(spark, sf_dir):
    rows = [("404 not found", None), ("authentication_error", 0), ("Rate_Limit", 0), ("Overloaded", 0), ("x", 500), ("hit MAX_TOKENS", 0), ("field required: classes", 0), ("remote: permission denied", 0)]
    df = spark.createDataFrame(rows, "message string, code int")
    return df.select("message", "code", X.api_error_class(F.col("message"), F.col("code")).alias("kind"), X.is_truncation_error(F.col("message")).alias("truncated"), X.is_auth_error(F.col("message")).alias("refused"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '') AS plain, p[len(p) - 1] || '-' || p[len(p)] AS slug FROM (SELECT page_id, url, string_split(replace(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', ''), ':', '/'), '/') AS p FROM pages)")
def repository_slug(spark, sf_dir):
    plain = F.regexp_replace(F.regexp_replace("url", "/+$", ""), r"\.git$", "")
    return pages(spark, sf_dir).select("page_id", plain.alias("plain"), X.repo_slug(F.col("url")).alias("slug"))


@query("SELECT prefix, CAST(depth AS INT) AS depth, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM (SELECT loc, unnest(range(1, len(p))) AS depth, array_to_string(list_slice(p, 1, unnest(range(1, len(p)))), '/') AS prefix FROM (SELECT length(html) AS loc, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages)) GROUP BY ALL")
def path_tree(spark, sf_dir):
    rows = pages(spark, sf_dir).select(F.regexp_replace("url", "[?#].*$", "").alias("path"), F.length("html").alias("loc"))
    return S.path_prefixes(rows)


@query("SELECT lang, string_agg(doc_id, ',' ORDER BY doc_id) AS ids, CAST(max(n_chars) AS BIGINT) AS most, round(sum(n_chars)::DOUBLE / greatest(sum(length(left(text, 120))), 1), 4) AS reduction FROM documents GROUP BY 1")
def group_concat_by_module(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    ratio = F.sum("n_chars") / F.greatest(F.sum(F.length(F.left("text", F.lit(120)))), F.lit(1))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(ids.alias("ids"), F.max("n_chars").alias("most"), F.round(ratio, 4).alias("reduction"))
