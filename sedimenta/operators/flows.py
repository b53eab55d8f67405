"""Traces of requests: controller, service, repository, table, by joins of a fixed number of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import rules as R
from sedimenta.functions import text as X
from sedimenta.operators.deps import db_tables
from sedimenta.operators.merge import first_wins, last_wins


def fields(files: DataFrame) -> DataFrame:
    """class_name, field, type of private fields, the last of a name, by the first type named in each file."""
    rows = files.select(F.regexp_extract("content", R.TYPE_NAME, 1).alias("class_name"), "path", F.posexplode(F.arrays_zip(F.regexp_extract_all("content", F.lit(R.FIELD), F.lit(2)).alias("f"), F.regexp_extract_all("content", F.lit(R.FIELD), F.lit(1)).alias("t"))).alias("ord", "x"))
    rows = rows.where("class_name <> ''").select("class_name", F.col("x.f").alias("field"), F.col("x.t").alias("type"), F.struct("path", "ord").alias("o"))
    return last_wins(rows, ["class_name", "field"], "o").drop("o")


def calls(files: DataFrame) -> DataFrame:
    """class_name, method, pos, object, called: calls in each method's body, which ends where the next method begins. Of equal
    class and method names the last is kept."""
    heads = F.regexp_extract_all("content", F.lit(R.METHOD), F.lit(1))
    parts = F.split("content", R.METHOD)
    bodies = F.slice(parts, F.lit(2), F.size(parts))
    pairs = F.arrays_zip(heads.alias("method"), bodies.alias("body"))
    rows = files.select(F.regexp_extract("content", R.TYPE_NAME, 1).alias("class_name"), "path", F.posexplode(pairs).alias("ord", "m")).where("class_name <> ''")
    rows = rows.select("class_name", F.col("m.method").alias("method"), F.col("m.body").alias("body"), F.struct("path", "ord").alias("o"))
    last = last_wins(rows, ["class_name", "method"], "o")
    found = F.arrays_zip(F.regexp_extract_all("body", F.lit(R.CALL), F.lit(1)).alias("object"), F.regexp_extract_all("body", F.lit(R.CALL), F.lit(2)).alias("called"))
    return last.select("class_name", "method", F.posexplode(found).alias("pos", "c")).select("class_name", "method", "pos", "c.*")


def implementations(classes: DataFrame) -> DataFrame:
    """type and concrete: the last class that implements each interface."""
    rows = classes.select(F.explode("implements").alias("i"), F.col("name").alias("concrete"), F.struct("file_path", "class_ord").alias("o"))
    return last_wins(rows.select(X.without_generics(F.col("i")).alias("type"), "concrete", "o"), ["type"], "o").drop("o")


def resolved_calls(files: DataFrame, classes: DataFrame) -> DataFrame:
    """class_name, method, pos, target, target_method, role, file: calls on fields whose type, or what implements it, is known."""
    index = last_wins(classes.select("name", "role", "file_path", F.struct("file_path", "class_ord").alias("o")), ["name"], "o").select(F.col("name").alias("target"), F.col("role").alias("target_role"), F.col("file_path").alias("target_file"))
    typed = calls(files).join(fields(files).withColumnRenamed("field", "object"), ["class_name", "object"])
    concrete = typed.join(implementations(classes), "type", "left").withColumn("target", F.coalesce("concrete", "type"))
    return concrete.join(index, "target").select("class_name", "method", "pos", "target", F.col("called").alias("target_method"), "target_role", "target_file")


def cache_tags(services: DataFrame, files: DataFrame) -> DataFrame:
    """class_name, method, tags, transactional: cache annotations near the method's name in the class's file."""
    rows = services.join(files.select(F.col("path").alias("file"), "content"), "file", "left")
    marks = F.arrays_zip(F.regexp_extract_all("content", F.lit(R.CACHE_OPERATION), F.lit(0)).alias("all"), F.regexp_extract_all("content", F.lit(R.CACHE_OPERATION), F.lit(1)).alias("op"), F.regexp_extract_all("content", F.lit(R.CACHE_OPERATION), F.lit(2)).alias("name"))

    def near(m):
        at = F.position(m["all"], F.col("content"))
        start = F.greatest(at - 300, F.lit(1))
        return F.contains(F.substr("content", start, at + 50 - start), F.col("method"))

    tags = F.transform(F.filter(marks, near), lambda m: F.concat(F.lit("@"), m["op"], F.lit('("'), m["name"], F.lit('")')))
    return rows.select("class_name", "method", F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), F.coalesce(F.contains("content", F.lit("@Transactional")), F.lit(False)).alias("transactional"))


def endpoint_flows(files: DataFrame, classes: DataFrame, methods: DataFrame, per_handler_security: bool = True) -> DataFrame:
    """One row for each endpoint of a controller: path, security, steps, tables, cache operations and a summary.

    Per endpoint the first call of each service counts, per service the first of each repository, in order of calls; a class
    counts as called before its role is looked at. Tables come from entities of a repository's stem."""
    source = files.select(F.col("path").alias("file_path"), "content")
    key = ["file_path", "class_ord", "method_ord"]
    ends = methods.where("role = 'controller' and http_method is not null").select(*key, "http_method", X.flow_path(F.col("base_path"), F.col("http_path")).alias("path"), F.col("class_name").alias("controller"), F.col("name").alias("handler"))
    # The part of the file in which a handler's own annotations stand: what precedes its name, back to the last closing brace.
    before = F.element_at(F.split(F.split("content", F.concat(F.lit(r"\b"), F.col("handler"), F.lit(r"\s*\(")), 2)[0], r"[};]\s*\n"), -1)
    where = before if per_handler_security else F.col("content")
    secured = F.regexp_extract(where, R.SECURED, 1)
    security = F.when(secured == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(secured, ","), lambda s: F.trim(F.trim(s), F.lit('"'))))
    ends = ends.join(source, "file_path", "left").select(*ends.columns, F.coalesce(security, F.array().cast("array<string>")).alias("security"))

    every = resolved_calls(files, classes)
    caller = every.withColumnsRenamed({"class_name": "controller", "method": "handler"})
    to_service = ends.join(caller, ["controller", "handler"]).select(*key, "pos", F.col("target").alias("service"), F.col("target_method").alias("service_method"), "target_role", F.col("target_file").alias("service_file"))
    services = first_wins(to_service, [*key, "service"], ["pos"]).where(F.col("target_role").isin("service", "security", "component"))
    tagged = cache_tags(services.select(F.col("service").alias("class_name"), F.col("service_method").alias("method"), F.col("service_file").alias("file")).distinct(), files)
    services = services.join(tagged.select(F.col("class_name").alias("service"), F.col("method").alias("service_method"), "tags", "transactional"), ["service", "service_method"])

    caller = every.withColumnsRenamed({"class_name": "service", "method": "service_method", "pos": "repo_pos"})
    to_repo = services.select(*key, "service", "service_method", F.col("pos").alias("service_pos")).join(caller, ["service", "service_method"])
    repos = to_repo.select(*key, "service", "service_pos", "repo_pos", F.col("target").alias("repo"), F.col("target_method").alias("repo_method"), "target_role", F.col("target_file").alias("repo_file"))
    repos = first_wins(repos, [*key, "service", "repo"], ["repo_pos"]).where(F.col("target_role").isin("repository", "model"))
    tables = db_tables(files)
    full = F.when(F.col("schema") == "default", F.col("table")).otherwise(F.concat("schema", F.lit("."), "table"))
    by_stem = tables.withColumn("stem", X.entity_stem(F.col("path"))).groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "ord", full.alias("t")))), lambda x: x["t"]).alias("tables"))
    repos = repos.withColumn("stem", X.repository_stem(F.col("repo"))).join(by_stem, "stem", "left")

    empty = F.array().cast("array<string>")
    service_step = F.struct(F.col("pos").alias("a"), F.lit(-1).alias("b"), F.lit("service").alias("layer"), F.col("service").alias("class"), F.col("service_method").alias("method"), F.array_join(F.concat(F.when(F.col("transactional"), F.array(F.lit("@Transactional"))).otherwise(empty), F.col("tags")), " ").alias("detail"), F.col("service_file").alias("file"), F.col("tags").alias("tags"), empty.alias("tables"))
    repo_detail = F.when(F.size("tables") > 0, F.array_join("tables", ", ")).otherwise(F.concat("stem", F.lit(" (JPA)")))
    repo_step = F.struct(F.col("service_pos").alias("a"), F.col("repo_pos").alias("b"), F.lit("repository").alias("layer"), F.col("repo").alias("class"), F.col("repo_method").alias("method"), repo_detail.alias("detail"), F.col("repo_file").alias("file"), empty.alias("tags"), F.coalesce("tables", empty).alias("tables"))
    steps = services.select(*key, service_step.alias("s")).unionByName(repos.select(*key, repo_step.alias("s")))
    traced = steps.groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("inner"))

    rows = ends.join(traced, key, "left").withColumn("inner", F.coalesce("inner", F.expr("filter(array(named_struct('a', 0, 'b', 0, 'layer', '', 'class', '', 'method', '', 'detail', '', 'file', '', 'tags', cast(array() as array<string>), 'tables', cast(array() as array<string>))), x -> false)")))
    step = lambda layer, cls, method, detail, file: F.struct(layer.alias("layer"), cls.alias("class"), method.alias("method"), detail.alias("detail"), file.alias("file"))
    tables_of = F.array_distinct(F.flatten(F.transform("inner", lambda s: s["tables"])))
    ops = F.array_distinct(F.flatten(F.transform("inner", lambda s: s["tags"])))
    names = F.array_distinct(F.transform(F.filter("inner", lambda s: s["layer"] == "service"), lambda s: s["class"]))
    rows = rows.withColumn("db_tables", tables_of).withColumn("cache_ops", ops).withColumn("services", names)
    all_steps = F.concat(
        F.array(step(F.lit("controller"), F.col("controller"), F.col("handler"), F.concat("http_method", F.lit(" "), "path"), F.col("file_path"))),
        F.transform("inner", lambda s: step(s["layer"], s["class"], s["method"], s["detail"], s["file"])),
        F.transform("db_tables", lambda t: step(F.lit("db"), F.lit("database"), F.lit(""), t, F.lit(""))),
    )
    summary = F.concat(
        F.col("http_method"),
        F.lit(" "),
        F.col("path"),
        F.lit(" → "),
        F.coalesce(X.blank_to_null(F.array_join("services", ", ")), F.lit("direct")),
        F.when(F.size("db_tables") > 0, F.concat(F.lit(" → "), F.array_join("db_tables", ", "))).otherwise(""),
        F.when(F.size("cache_ops") > 0, F.concat(F.lit(" [cache: "), F.array_join("cache_ops", ", "), F.lit("]"))).otherwise(""),
    )
    return rows.select(*key, "http_method", "path", "controller", "handler", "security", summary.alias("summary"), "cache_ops", "db_tables", empty.alias("messages_out"), all_steps.alias("steps"))


def call_chain(first: DataFrame, *hops: tuple[DataFrame, str, str]) -> DataFrame:
    """A path join of any fixed length: each hop is a table with the column on the left and on the right that must be equal."""
    out = first
    for table, left, right in hops:
        out = out.join(table, out[left] == table[right])
    return out


def filter_flows(flows: DataFrame, verbs: list[str] | None = None, controllers: list[str] | None = None, with_tables: bool = False) -> DataFrame:
    out = flows
    if verbs:
        out = out.where(F.col("http_method").isin(*verbs))
    if controllers:
        out = out.where(F.col("controller").isin(*controllers))
    return out.where(F.size("db_tables") > 0) if with_tables else out
