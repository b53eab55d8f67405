"""Queries over the corpus of Java sources. Their SQL is the rows to expect, told by hand from the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import text as X
from sedimenta.operators import deps, flows, javaparse, knowledge, merge, metrics, packing, retrieval, scan
from sedimenta.plans import corpus
from sedimenta.sources import files as S
from sedimenta.workers import reach

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(columns: str | None = None, *rows: str) -> Callable[[Query], Query]:
    """Register a query with the rows that it must give, as tuples of SQL; a column may be followed by its type."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if columns:
            parts = [c.split() for c in columns.split(", ")]
            picked = ", ".join(f"CAST({c[0]} AS {c[1]}) AS {c[0]}" if len(c) > 1 else c[0] for c in parts)
            SQL[f.__name__] = f"SELECT {picked} FROM (VALUES {', '.join(rows)}) t({', '.join(c[0] for c in parts)})"
        return f

    return add


def sources(spark: SparkSession, tests: bool = False) -> DataFrame:
    """The corpus as the file reader gives it: without excluded folders, and without tests."""
    rows = corpus.files(reach(spark)).where(~S.is_excluded(F.col("path")))
    return rows.where(S.is_test(F.col("path")) if tests else ~S.is_test(F.col("path")))


def parsed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    classes = javaparse.parse_files(sources(spark))
    return classes, javaparse.explode_methods(classes)


@query(
    "name, kind, role, module, base_path, extends VARCHAR, implements, dependencies, javadoc, methods",
    "('FilmController', 'class', 'controller', 'services.film', '/films', NULL, '', 'Logger,FilmService', '/** Films over HTTP. */', 4)",
    "('FilmService', 'interface', 'model', 'services.film', NULL, NULL, '', '', NULL, 2)",
    "('FilmServiceImpl', 'class', 'service', 'services.film', NULL, NULL, 'FilmService', 'FilmRepository,Audit', NULL, 2)",
    "('FilmRepository', 'interface', 'repository', 'services.film', NULL, NULL, '', '', NULL, 0)",
    "('FilmEntity', 'class', 'entity', 'services.film', NULL, NULL, '', '', NULL, 0)",
    "('Billing', 'interface', 'model', 'common', NULL, NULL, '', '', NULL, 0)",
    "('Listener', 'class', 'model', 'common', NULL, NULL, '', '', NULL, 1)",
    "('Size', 'enum', 'model', 'common', NULL, NULL, '', 'String', NULL, 2)",
    "('Point', 'record', 'record', 'common', NULL, NULL, '', '', NULL, 0)",
    "('Thing', 'sealed_class', 'entity', 'common', NULL, NULL, '', '', NULL, 0)",
    "('Fine', 'class', 'model', 'com.acme', NULL, NULL, '', '', NULL, 0)",
)
def java_classes(spark, sf_dir):
    classes, _ = parsed(spark)
    listed = (F.array_join(c, ",").alias(c) for c in ("implements", "dependencies"))
    return classes.select("name", "kind", "role", "module", "base_path", "extends", *listed, "javadoc", F.size("methods").alias("methods"))


@query(
    "class_name, signature, http_method, http_path, javadoc",
    "('FilmController', 'public void FilmController(FilmService filmService)', NULL, NULL, NULL)",
    "('FilmController', 'public Film getFilm(long id)', 'GET', '/{id}', '/** One film. */')",
    "('FilmController', 'public Film add(Film film, String... tags)', 'POST', NULL, NULL)",
    "('FilmController', 'public void remove(long id)', 'DELETE', '/{id}/', NULL)",
    "('FilmService', 'Film find(long id)', NULL, NULL, NULL)",
    "('FilmService', 'Film save(Film film)', NULL, NULL, NULL)",
    "('FilmServiceImpl', 'public Film find(long id)', NULL, NULL, NULL)",
    "('FilmServiceImpl', 'public Film save(Film film)', NULL, NULL, NULL)",
    "('Listener', 'public void onOrder(String message)', NULL, NULL, NULL)",
    "('Size', 'void Size(String code)', NULL, NULL, NULL)",
    "('Size', 'boolean big()', NULL, NULL, NULL)",
)
def java_methods(spark, sf_dir):
    return parsed(spark)[1].select("class_name", "signature", "http_method", "http_path", "javadoc")


@query(
    "class_name, name, cyclomatic_complexity, band",
    "('FilmController', 'FilmController', 1, 'simple')",
    "('FilmController', 'getFilm', 3, 'simple')",
    "('FilmController', 'add', 1, 'simple')",
    "('FilmController', 'remove', 1, 'simple')",
    "('FilmService', 'find', 1, 'simple')",
    "('FilmService', 'save', 1, 'simple')",
    "('FilmServiceImpl', 'find', 5, 'moderate')",
    "('FilmServiceImpl', 'save', 7, 'moderate')",
    "('Listener', 'onOrder', 1, 'simple')",
    "('Size', 'Size', 1, 'simple')",
    "('Size', 'big', 2, 'simple')",
)
def java_cc(spark, sf_dir):
    return parsed(spark)[1].select("class_name", "name", "cyclomatic_complexity", X.complexity_band(F.col("cyclomatic_complexity")).alias("band"))


@query("files BIGINT, lines_of_code BIGINT, classes BIGINT, interfaces BIGINT, enums BIGINT, methods BIGINT, rest_endpoints BIGINT", "(7, 119, 5, 3, 1, 11, 3)")
def java_totals(spark, sf_dir):
    return metrics.totals(parsed(spark)[0])


@query("role, n BIGINT", "('model', 5)", "('entity', 2)", "('controller', 1)", "('service', 1)", "('repository', 1)", "('record', 1)")
def java_roles(spark, sf_dir):
    return metrics.role_counts(parsed(spark)[0])


@query("module, classes BIGINT, methods BIGINT, loc BIGINT", "('services.film', 5, 8, 85)", "('common', 5, 3, 31)", "('com.acme', 1, 0, 3)")
def java_modules(spark, sf_dir):
    return metrics.module_stats(parsed(spark)[0])


@query("class_name, name, cyclomatic_complexity", "('FilmServiceImpl', 'save', 7)", "('FilmServiceImpl', 'find', 5)")
def java_hotspots(spark, sf_dir):
    return metrics.hotspots(parsed(spark)[1]).select("class_name", "name", "cyclomatic_complexity")


@query(
    "http_method, path, controller, handler",
    "('POST', '/films', 'FilmController', 'add')",
    "('GET', '/films/{id}', 'FilmController', 'getFilm')",
    "('DELETE', '/films/{id}', 'FilmController', 'remove')",
)
def java_endpoints(spark, sf_dir):
    return metrics.endpoints(parsed(spark)[1])


@query(
    "rule_id, severity, line, title",
    "('hardcoded_password', 'critical', 9, 'Password written into the source')",
    "('hardcoded_ip', 'low', 10, 'IP address written into the source')",
    "('sql_injection', 'critical', 15, 'Possible SQL injection')",
    "('weak_cryptography', 'high', 16, 'Weak cryptographic algorithm: MD5')",
    "('path_traversal', 'high', 17, 'Possible path traversal')",
    "('empty_catch_block', 'medium', 38, 'Empty catch block')",
    "('todo_comment', 'info', 23, 'TODO comment left in code')",
    "('complex_untested_method', 'medium', 0, 'Complex method with no apparent test, CC=5')",
    "('complex_untested_method', 'medium', 0, 'Complex method with no apparent test, CC=7')",
)
def java_findings(spark, sf_dir):
    tables = knowledge.analyse(sources(spark))
    return scan.sorted_findings(knowledge.findings(sources(spark), tables, sources(spark, tests=True))).select("rule_id", "severity", "line", "title")


@query(
    "kind, sub_type, direction, detail, file",
    "('database', 'JpaRepository', 'outbound', 'FilmRepository', 'FilmRepository.java')",
    "('cache', '@Cacheable', 'outbound', 'films', 'FilmServiceImpl.java')",
    "('rest_client', '@FeignClient', 'outbound', 'billing', 'Clients.java')",
    "('messaging', 'KafkaTemplate', 'outbound', 'done', 'Clients.java')",
    "('messaging', '@KafkaListener', 'inbound', 'orders', 'Clients.java')",
)
def dependency_inventory(spark, sf_dir):
    found = deps.unique_dependencies(deps.dependency_matches(sources(spark)))
    return found.select("kind", "sub_type", "direction", "detail", X.base_name(F.col("path")).alias("file"))


@query("kind, types BIGINT, total_unique BIGINT", "('database', 1, 5)", "('cache', 1, 5)", "('rest_client', 1, 5)", "('messaging', 2, 5)")
def dependency_summary(spark, sf_dir):
    return deps.dependency_summary(deps.dependency_matches(sources(spark)))


@query('"table", "schema", file', "('film', 'shop', 'FilmEntity.java')", "('thing', 'default', 'Clients.java')")
def db_tables(spark, sf_dir):
    return deps.db_tables(sources(spark)).select("table", "schema", X.base_name(F.col("path")).alias("file"))


@query("name, url, path", "('billing', 'http://billing.invalid', '/v1')")
def feign_clients(spark, sf_dir):
    return deps.feign_clients(sources(spark)).select("name", "url", "path")


@query(
    "http_method, path, handler, security, summary, cache_ops, steps",
    "('GET', '/films/{id}', 'getFilm', 'ROLE_USER,ROLE_ADMIN', 'GET /films/{id} → FilmServiceImpl → shop.film [cache: @Cacheable(\"films\")]', '@Cacheable(\"films\")', 'controller:FilmController.getFilm|service:FilmServiceImpl.find|repository:FilmRepository.findById|db:database.')",
    "('POST', '/films', 'add', 'ROLE_ADMIN', 'POST /films → FilmServiceImpl → shop.film', '', 'controller:FilmController.add|service:FilmServiceImpl.save|repository:FilmRepository.save|db:database.')",
    "('DELETE', '/films/{id}', 'remove', '', 'DELETE /films/{id} → direct', '', 'controller:FilmController.remove')",
)
def endpoint_flows(spark, sf_dir):
    classes, methods = parsed(spark)
    rows = flows.endpoint_flows(sources(spark), classes, methods)
    step = lambda s: F.concat(s["layer"], F.lit(":"), s["class"], F.lit("."), s["method"])
    return rows.select("http_method", "path", "handler", F.array_join("security", ",").alias("security"), "summary", F.array_join("cache_ops", ",").alias("cache_ops"), F.array_join(F.transform("steps", step), "|").alias("steps"))


@query("kind, topic, group_id, consumer_class, handler, detail", "('kafka', 'orders', 'g1', 'Listener', 'onOrder', '@KafkaListener(\"orders\")')")
def consumer_flows(spark, sf_dir):
    return deps.consumer_flows(sources(spark)).select("kind", "topic", "group_id", "consumer_class", "handler", "detail")


@query(
    "name, digest",
    "('Fine', 'FILE: src/main/java/com/acme/Broken.java' || chr(10) || 'CLASS: com.acme.Fine  [role=model]')",
    "('Billing', 'FILE: src/main/java/com/acme/common/Clients.java' || chr(10) || 'INTERFACE: com.acme.common.Billing  [role=model]' || chr(10) || '  annotations: @FeignClient')",
    "('Listener', 'FILE: src/main/java/com/acme/common/Clients.java' || chr(10) || 'CLASS: com.acme.common.Listener  [role=model]' || chr(10) || '  - public void onOrder(String message) (cc=1)')",
    "('Size', 'FILE: src/main/java/com/acme/common/Clients.java' || chr(10) || 'ENUM: com.acme.common.Size  [role=model]' || chr(10) || '  injected deps: String' || chr(10) || '  - void Size(String code) (cc=1)' || chr(10) || '  - boolean big() (cc=2)')",
    "('Point', 'FILE: src/main/java/com/acme/common/Clients.java' || chr(10) || 'RECORD: com.acme.common.Point  [role=record]')",
    "('Thing', 'FILE: src/main/java/com/acme/common/Clients.java' || chr(10) || 'SEALED_CLASS: com.acme.common.Thing  [role=entity]' || chr(10) || '  annotations: @Entity')",
    "('FilmController', 'FILE: src/main/java/com/acme/services/film/FilmController.java' || chr(10) || 'CLASS: com.acme.services.film.FilmController  [role=controller]' || chr(10) || '  annotations: @RestController, @RequestMapping' || chr(10) || '  base path: /films' || chr(10) || '  injected deps: FilmService, Logger' || chr(10) || '  javadoc: /** Films over HTTP. */' || chr(10) || '  - public void FilmController(FilmService filmService) (cc=1)' || chr(10) || '  - public Film getFilm(long id) [GET /{id}] (cc=3)' || chr(10) || '      doc: /** One film. */' || chr(10) || '  - public Film add(Film film, String... tags) [POST ] (cc=1)' || chr(10) || '  - public void remove(long id) [DELETE /{id}/] (cc=1)')",
    "('FilmServiceImpl', 'FILE: src/main/java/com/acme/services/film/FilmServiceImpl.java' || chr(10) || 'CLASS: com.acme.services.film.FilmServiceImpl  [role=service]' || chr(10) || '  annotations: @Service' || chr(10) || '  implements: FilmService' || chr(10) || '  injected deps: Audit, FilmRepository' || chr(10) || '  - public Film find(long id) (cc=5)' || chr(10) || '  - public Film save(Film film) (cc=7)')",
    "('FilmRepository', 'FILE: src/main/java/com/acme/services/film/FilmRepository.java' || chr(10) || 'INTERFACE: com.acme.services.film.FilmRepository  [role=repository]')",
    "('FilmEntity', 'FILE: src/main/java/com/acme/services/film/FilmEntity.java' || chr(10) || 'CLASS: com.acme.services.film.FilmEntity  [role=entity]' || chr(10) || '  annotations: @Entity, @Table')",
    "('FilmService', 'FILE: src/main/java/com/acme/services/film/FilmService.java' || chr(10) || 'INTERFACE: com.acme.services.film.FilmService  [role=model]' || chr(10) || '  - Film find(long id) (cc=1)' || chr(10) || '  - Film save(Film film) (cc=1)')",
)
def class_digests(spark, sf_dir):
    classes, _ = parsed(spark)
    cards = packing.class_digests(classes).join(classes.select("file_path", "class_ord", "name"), ["file_path", "class_ord"])
    return cards.select("name", "digest")


@query(
    "qualified_name, name, description",
    "('com.acme.common.Listener', 'onOrder', 'Implements `onOrder` as declared: public void onOrder(String message).')",
    "('com.acme.common.Size', 'Size', 'Implements `Size` as declared: void Size(String code).')",
    "('com.acme.common.Size', 'big', 'Implements `big` as declared: boolean big().')",
    "('com.acme.services.film.FilmService', 'find', 'Finds resource.')",
    "('com.acme.services.film.FilmService', 'save', 'Implements `save` as declared: Film save(Film film).')",
    "('com.acme.services.film.FilmServiceImpl', 'find', 'Finds resource.')",
    "('com.acme.services.film.FilmServiceImpl', 'save', 'Implements `save` as declared: public Film save(Film film).')",
    "('com.acme.services.film.FilmController', 'FilmController', 'Implements `FilmController` as declared: public void FilmController(FilmService filmService).')",
    "('com.acme.services.film.FilmController', 'getFilm', 'Retrieves film.')",
    "('com.acme.services.film.FilmController', 'add', 'Creates resource.')",
    "('com.acme.services.film.FilmController', 'remove', 'Implements `remove` as declared: public void remove(long id).')",
)
def heuristic_methods(spark, sf_dir):
    classes, methods = parsed(spark)
    _, notes = merge.heuristic_insights(classes, methods)
    return notes.select("qualified_name", "name", "description")


@query()
def knowledge_json(spark, sf_dir):
    return knowledge.document(knowledge.analyse(sources(spark)), {"repository": "corpus", "analyzer_version": "1"})


@query()
def knowledge_nodes(spark, sf_dir):
    return knowledge.nodes(knowledge.analyse(sources(spark)))


@query()
def knowledge_answer(spark, sf_dir):
    nodes = knowledge.nodes(knowledge.analyse(sources(spark))).cache()
    return retrieval.extractive_answer(retrieval.retrieve(nodes, "Which class handles films over HTTP?", "auto", 3), nodes)
