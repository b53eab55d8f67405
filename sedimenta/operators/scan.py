"""Line and literal scanners. A file's lines are made once, and all rules look at a line in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import rules as R
from sedimenta.functions import text as X

SNIPPET = 120


def file_lines(files: DataFrame, ahead: int = 2) -> DataFrame:
    """files without content, with line from 1, text, and block: the line and so many after it, joined by spaces.

    Lines and blocks are made inside the array of the file's lines, and only they leave it: the work grows with the lines, and
    no window or shuffle is needed."""
    own = [c for c in files.columns if c != "content"]
    every = F.col("__lines")
    block = lambda x, i: F.array_join(F.slice(every, i + 1, F.lit(ahead + 1)), " ") if ahead else x
    rows = F.transform(every, lambda x, i: F.struct(x.alias("text"), (i + 1).alias("line"), block(x, i).alias("block")))
    return files.withColumn("__lines", X.lines(F.col("content"))).select(*own, F.explode(rows).alias("__row")).select(*own, "__row.*")


def _hit(rule: R.LineRule) -> Column:
    out = F.col("text").rlike(rule.pattern)
    low = F.lower("text")
    if rule.words:
        any_word = F.lit(False)
        for w in rule.words:
            any_word = any_word | F.contains(low, F.lit(w))
        out = out & any_word
    if rule.rule_id == "empty_catch_block":
        out = out & F.col("block").rlike(R.EMPTY_CATCH)
    return out


def _finding(rule: R.LineRule, order: int) -> Column:
    title = F.lit(rule.title)
    if rule.group:
        named = F.regexp_extract("text", rule.pattern, rule.group)
        title = F.concat(named if rule.title.endswith(": ") else F.upper(named), F.lit(rule.title)) if not rule.title.endswith(": ") else F.concat(F.lit(rule.title), named)
    return F.struct(
        F.lit(rule.category).alias("category"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.severity).alias("severity"),
        title.alias("title"),
        F.lit(rule.suggestion).alias("suggestion"),
        F.lit(order).alias("rule_ord"),
    )


def line_findings(files: DataFrame, rules: tuple[R.LineRule, ...] = R.LINE_RULES) -> DataFrame:
    """A row for each line and rule it meets. Files that no rule's pattern is in are dropped before their lines are made."""
    some = F.col("content").rlike(_joined([r.pattern for r in rules]))
    hits = F.array_compact(F.array(*(F.when(_hit(r), _finding(r, k)) for k, r in enumerate(rules))))
    found = file_lines(files.where(some)).withColumn("f", F.explode(hits))
    return found.select("path", "line", F.left(F.trim("text"), F.lit(SNIPPET)).alias("snippet"), "f.*")


def secret_rule(*tested: Column) -> Column:
    """The first secret rule that one of the texts meets, as a struct; null if none does. Later rules aren't tried."""
    out = None
    for k, (rule_id, severity, title, pattern) in enumerate(R.SECRETS):
        hit = F.lit(False)
        for c in tested:
            hit = hit | c.rlike(pattern)
        value = F.struct(F.lit("secret").alias("category"), F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit("Keep secrets out of sources, and change this one.").alias("suggestion"), F.lit(k - len(R.SECRETS)).alias("rule_ord"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _joined(patterns: list[str]) -> str:
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


#: What some secret rule meets; and the same without looking ahead, which what a line meets meets wherever the line stands.
ANY_SECRET = _joined([r[3] for r in R.SECRETS])
MAYBE_SECRET = _joined([r[3].replace(r"(?!.*\$\{)", "") for r in R.SECRETS])


def secret_lines(files: DataFrame) -> DataFrame:
    """Lines (columns of files, text, line) that meet a secret rule, with the first such rule, f. Files and lines that meet none
    are dropped by one pattern each before the rules are told apart."""
    lines = file_lines(files.where(F.col("content").rlike(MAYBE_SECRET)), 0).drop("block")
    return lines.where(F.col("text").rlike(ANY_SECRET)).withColumn("f", secret_rule(F.col("text")))


def secret_findings(files: DataFrame, literals: DataFrame) -> DataFrame:
    """A row for each string literal (path, line, value) that meets a secret rule by itself or by its line. Snippets carry the
    value redacted."""
    some = files.select("path", "content").where(F.col("content").rlike(MAYBE_SECRET))
    lines = file_lines(some, 0).select("path", "line", F.trim("text").alias("context"))
    value = F.regexp_replace("value", "^[\"']+|[\"']+$", "")
    rows = literals.withColumn("plain", value).join(lines, ["path", "line"])
    rows = rows.where(F.col("context").rlike(ANY_SECRET) | F.col("plain").rlike(ANY_SECRET)).withColumn("f", secret_rule(F.col("context"), F.col("plain")))
    shown = F.when(F.col("plain") == "", F.col("context")).otherwise(F.replace("context", F.col("plain"), X.redact(F.col("plain"))))
    return rows.select("path", "line", F.left(shown, F.lit(SNIPPET)).alias("snippet"), "f.*", X.redact(F.col("plain")).alias("redacted"))


def coverage_gaps(classes: DataFrame, methods: DataFrame, tests: DataFrame, least: int = 5) -> DataFrame:
    """Methods of complexity least or more of classes that no test's stem is in, nor they in a stem.

    Stems are few beside classes; where they may be broadcast, Spark does it by their size."""
    stems = tests.select(X.test_stem(F.col("path")).alias("stem")).where("stem <> ''").distinct()
    named = classes.select("file_path", "class_ord", F.lower("name").alias("low"))
    bare = named.join(stems, F.contains("low", F.col("stem")) | F.contains("stem", F.col("low")), "left_anti")
    severity = F.when(F.col("cyclomatic_complexity") < 10, "medium").otherwise("high")
    rows = methods.where(F.col("cyclomatic_complexity") >= least).join(bare.select("file_path", "class_ord"), ["file_path", "class_ord"])
    title = F.concat(F.lit("Complex method with no apparent test, CC="), F.col("cyclomatic_complexity"))
    return rows.select(
        F.col("file_path").alias("path"),
        F.lit(0).alias("line"),
        F.col("signature").alias("snippet"),
        F.lit("coverage_gap").alias("category"),
        F.lit("complex_untested_method").alias("rule_id"),
        severity.alias("severity"),
        title.alias("title"),
        F.lit("Test each path through the method.").alias("suggestion"),
        F.lit(len(R.LINE_RULES)).alias("rule_ord"),
    )


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, R.SEVERITIES)), c)


def severity_summary(findings: DataFrame, severities: tuple[str, ...] = R.SEVERITIES) -> DataFrame:
    """severity, rank, n for every level, 0 where nothing was found, in order of rank."""
    spark = findings.sparkSession
    every = spark.range(1).select(F.posexplode(F.array(*map(F.lit, severities))).alias("rank", "severity"))
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return every.join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n")).orderBy("rank")


def counts_desc(findings: DataFrame, column: str = "rule_id", order: str | None = None) -> DataFrame:
    """n by a column, largest first; ties by the first appearance."""
    first = F.min(order) if order else F.min(column)
    return findings.groupBy(column).agg(F.count("*").alias("n"), first.alias("first")).orderBy(F.desc("n"), "first").drop("first")


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By severity, then in scan order."""
    return findings.orderBy(severity_rank(F.col("severity")), "path", "rule_ord", "line")
