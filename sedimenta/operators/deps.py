"""Inventory of integrations, tables, clients and message consumers in source files (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import rules as R
from sedimenta.functions import text as X
from sedimenta.operators.merge import first_wins

#: Characters before a line and after it in which a detail is looked for.
BEFORE, AFTER = 5, 200


def dependency_matches(files: DataFrame) -> DataFrame:
    """A row for each line and integration: kind, sub_type, direction, detail, path, line, rule_ord. Files that no pattern is in
    are dropped before their lines are made, and the patterns that a file has are told once for all its lines."""
    has = F.array(*(F.col("content").rlike(p) for _, _, _, p, _ in R.INTEGRATIONS))
    some = files.select("path", "content", has.alias("has")).where(F.exists("has", lambda x: x))
    lined = some.withColumn("lines", X.lines(F.col("content"))).withColumn("tail", F.when(F.col("content").rlike("[\r\n]$"), "\n").otherwise(""))
    # Lines that some pattern is in, and then what stands around those, are taken inside the array of the file's lines.
    any_ = "|".join(f"(?:{p})" for _, _, _, p, _ in R.INTEGRATIONS)
    told = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("text"), (i + 1).alias("line"))), lambda s: s["text"].rlike(any_))
    lines = F.col("lines")

    def around(s):
        """The line, BEFORE characters before it and AFTER behind it, which that many lines at the most take up."""
        near = F.transform(F.slice(lines, F.greatest(s["line"] - BEFORE, F.lit(1)), F.least(s["line"] - 1, F.lit(BEFORE))), lambda x: F.concat(F.right(x, F.lit(BEFORE)), F.lit("\n")))
        behind = F.transform(F.slice(lines, s["line"] + 1, F.lit(AFTER)), lambda x: F.concat(F.lit("\n"), F.left(x, F.lit(AFTER))))
        return F.concat(F.right(F.array_join(near, ""), F.lit(BEFORE)), s["text"], F.left(F.concat(F.array_join(behind, ""), F.col("tail")), F.lit(AFTER)))

    hits = lined.withColumn("told", told).select("path", "has", F.explode(F.transform("told", lambda s: F.struct(s["text"].alias("text"), s["line"].alias("line"), around(s).alias("window")))).alias("l"))
    rows = hits.select("path", "has", "l.*")

    def match(k: int, rule: tuple):
        kind, sub_type, direction, pattern, detail = rule
        value = F.regexp_extract("window", detail, 1) if detail else F.lit("")
        fields = F.struct(F.lit(kind).alias("kind"), F.lit(sub_type).alias("sub_type"), F.lit(direction).alias("direction"), value.alias("detail"), F.lit(k).alias("rule_ord"))
        return F.when(F.get("has", F.lit(k)) & F.col("text").rlike(pattern), fields)

    found = F.array_compact(F.array(*(match(k, r) for k, r in enumerate(R.INTEGRATIONS))))
    return rows.select("path", "line", F.explode(found).alias("d")).select("path", "line", "d.*")


def unique_dependencies(matches: DataFrame) -> DataFrame:
    """The first match of each kind, type and detail, in order of files, rules and lines."""
    return first_wins(matches, ["kind", "sub_type", "detail"], ["path", "rule_ord", "line"])


def dependency_summary(matches: DataFrame) -> DataFrame:
    """kind, types: distinct types over all matches, and total_unique on each row."""
    total = unique_dependencies(matches).agg(F.count("*").alias("total_unique"))
    return matches.groupBy("kind").agg(F.count_distinct("sub_type").alias("types")).crossJoin(F.broadcast(total))


def db_tables(files: DataFrame) -> DataFrame:
    """table, schema, path, ord: names in table annotations, or, in files without one, of entities."""
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(R.TABLE), F.lit(1)).alias("table"), F.regexp_extract_all("content", F.lit(R.TABLE), F.lit(2)).alias("schema"))
    named = files.where(F.col("content").rlike(R.TABLE)).select("path", F.posexplode(pairs).alias("ord", "t"))
    named = named.select(F.col("t.table").alias("table"), F.when(F.col("t.schema") == "", "default").otherwise(F.col("t.schema")).alias("schema"), "path", "ord")
    entities = F.filter(F.regexp_extract_all("content", F.lit(R.ENTITY), F.lit(1)), lambda x: x != "")
    plain = files.where(~F.col("content").rlike(R.TABLE)).select("path", F.posexplode(entities).alias("ord", "table"))
    return named.unionByName(plain.select("table", F.lit("default").alias("schema"), "path", "ord"))


def feign_clients(files: DataFrame) -> DataFrame:
    """name, url, path of each declared client, and the file it is in."""
    rows = files.where(F.col("content").rlike(R.FEIGN)).select(F.col("path").alias("file"), F.posexplode(F.regexp_extract_all("content", F.lit(R.FEIGN), F.lit(1))).alias("ord", "a"))
    one = lambda p: F.regexp_extract("a", p, 1)
    name = F.coalesce(*(F.when(one(p) != "", one(p)) for p in (r'name\s*=\s*"([^"]+)"', r'"([^"]+)"')), F.lit("unknown"))
    return rows.select(name.alias("name"), one(r'url\s*=\s*"([^"]+)"').alias("url"), one(r'path\s*=\s*"([^"]+)"').alias("path"), "file", "ord")


def consumer_flows(files: DataFrame) -> DataFrame:
    """kind, topic, group_id, consumer_class, handler, path and step of each listener. The handler is looked for in what
    follows the annotation, and a file is read for all kinds at once."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.java$", "")
    def of(kind: str, pattern: str, k: int):
        topics = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        parts = F.split("content", pattern)
        behind = F.slice(parts, F.lit(2), F.size(parts))
        return F.transform(F.arrays_zip(topics.alias("topic"), behind.alias("behind")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("kind_ord"), x["topic"].alias("topic"), x["behind"].alias("behind")))

    every = F.flatten(F.array(*(of(kind, p, k) for k, (kind, p) in enumerate(R.CONSUMERS))))
    some = files.where(F.col("content").rlike("@(Kafka|Rabbit|Sqs|Jms)Listener"))
    rows = some.select("path", "content", F.posexplode(every).alias("ord", "c"))
    or_else = lambda c, e: F.when(c != "", c).otherwise(e)
    handler = or_else(F.regexp_extract("c.behind", R.HANDLER, 1), F.lit("handle"))
    owner = or_else(F.regexp_extract("content", R.CLASS_NAME, 1), base)
    detail = F.concat(F.lit("@"), F.initcap("c.kind"), F.lit('Listener("'), F.col("c.topic"), F.lit('")'))
    return rows.select(
        F.col("c.kind").alias("kind"), F.col("c.topic").alias("topic"), F.regexp_extract("content", R.GROUP_ID, 1).alias("group_id"), owner.alias("consumer_class"), handler.alias("handler"), "path", detail.alias("detail"), "ord"
    )
