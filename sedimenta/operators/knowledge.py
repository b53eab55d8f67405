"""The whole analysis of a source tree as one nested document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.operators import javaparse, merge, metrics, packing, retrieval, scan


def analyse(files: DataFrame, insights: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """classes, methods, and both with summaries and descriptions, from files (path, content). Without insights they are told
    from names. Parsed types are cached, as every table below is made of them; release() gives them back."""
    classes = javaparse.parse_files(files).cache()
    methods = javaparse.explode_methods(classes)
    about, notes = insights or merge.heuristic_insights(classes, methods)
    told = merge.merge_insights(classes, about)
    return {"classes": classes, "methods": methods, "merged": retrieval.described(told, merge.merge_methods(methods, notes)), "digests": packing.class_digests(classes)}


def release(tables: dict[str, DataFrame]) -> None:
    """Give back what analyse() cached, once nothing made of it is needed."""
    tables["classes"].unpersist()


def overview() -> dict[str, str]:
    """The overview that is given where no service was asked."""
    return {"purpose": "Told from names and annotations alone.", "functionality": "", "architecture": "", "technology_stack": "", "design_patterns": "", "noteworthy_aspects": ""}


def document(tables: dict[str, DataFrame], metadata: dict[str, str] | None = None, budget: int = 8000, observations: DataFrame | None = None) -> DataFrame:
    """One row, knowledge: JSON with metadata, overview, statistics and modules. Lists are in order; a module's classes are by
    name, and it has the observations (module, ord, observation) about it; those about other modules are let be. The document
    is a report, of the size of a code base's outline."""
    classes, methods, merged = tables["classes"], tables["methods"], tables["merged"]
    as_list = lambda df, *order: df.agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))).alias("x"))
    one = F.struct("name", "class_ord", "qualified_name", "kind", "role", F.col("file_path").alias("file"), "annotations", "extends", "implements", "summary", "methods")
    by_module = merged.groupBy("module").agg(F.count("*").alias("class_count"), F.array_sort(F.collect_list(one)).alias("classes"))
    if observations is not None:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "observation"))), lambda x: x["observation"])
        by_module = by_module.join(observations.groupBy("module").agg(listed.alias("observations")), "module", "left")
    chunks = packing.pack(tables["digests"], budget, ["file_path", "class_ord"])
    info = F.create_map(*(F.lit(x) for p in (metadata or {}).items() for x in p)) if metadata else F.create_map().cast("map<string,string>")
    row = metrics.totals(classes).select(F.struct("*").alias("totals"))
    for name, part in (
        ("class_roles", as_list(metrics.role_counts(classes), "role")),
        ("modules_stats", as_list(metrics.module_stats(classes), "module")),
        ("cyclomatic_complexity", metrics.complexity_summary(methods).select(F.struct("*").alias("x"))),
        ("complexity_hotspots", as_list(metrics.hotspots(methods).select((-F.col("cyclomatic_complexity")).alias("order"), "file_path", "class_ord", "method_ord", "qualified_name", "name", "signature", "cyclomatic_complexity"), "order", "file_path", "class_ord", "method_ord")),
        ("rest_endpoints", as_list(metrics.endpoints(methods), "controller", "path")),
        ("modules", as_list(by_module, "module")),
        ("chunks", chunks.agg(F.struct(F.count("*").alias("chunks_total"), F.coalesce(F.max("tokens"), F.lit(0)).alias("largest")).alias("x"))),
    ):
        row = row.crossJoin(part.select(F.col("x").alias(name)))  # rows of one
    facets = F.create_map(*(F.lit(x) for p in overview().items() for x in p))
    statistics = F.struct("totals", "class_roles", F.col("modules_stats").alias("modules"), "cyclomatic_complexity", "complexity_hotspots", "rest_endpoints")
    return row.select(F.to_json(F.struct(info.alias("metadata"), F.col("chunks").alias("token_strategy"), facets.alias("project_overview"), statistics.alias("statistics"), "modules")).alias("knowledge"))


def nodes(tables: dict[str, DataFrame], observations: DataFrame | None = None) -> DataFrame:
    """The nodes of an analysis, with observations (module, ord, observation) about its modules."""
    classes, methods = tables["classes"], tables["methods"]
    spark = classes.sparkSession
    facets = spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for p in overview().items() for x in p))).alias("facet", "text"))
    core = metrics.totals(classes).crossJoin(metrics.complexity_summary(methods))  # rows of one
    if observations is None:
        seen = spark.range(0).select(F.lit("").alias("module"), F.col("id").alias("ord"), F.lit("").alias("observation"))
    else:
        seen = observations.select("module", "ord", "observation").join(tables["merged"].select("module").distinct(), "module", "left_semi")
    return retrieval.load_nodes(facets, core, metrics.hotspots(methods), metrics.endpoints(methods), seen, tables["merged"])


def findings(files: DataFrame, tables: dict[str, DataFrame], tests: DataFrame) -> DataFrame:
    """All findings of a tree: secrets, line rules, complex methods without tests."""
    shared = ["path", "line", "snippet", "category", "rule_id", "severity", "title", "suggestion", "rule_ord"]
    secrets = scan.secret_findings(files, javaparse.literals(files))
    gaps = scan.coverage_gaps(tables["classes"], tables["methods"], tests)
    return secrets.select(shared).unionByName(scan.line_findings(files).select(shared)).unionByName(gaps.select(shared))
