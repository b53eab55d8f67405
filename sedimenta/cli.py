"""Command line: analyse a source tree, report on it, or ask about one that was analysed.

    python -m sedimenta.cli analyse --repo TREE --output FOLDER [--include-tests] [--budget TOKENS] [--observations JSON]
    python -m sedimenta.cli report --repo TREE --output FOLDER [--kind security|dependencies|flows|all]
    python -m sedimenta.cli telemetry --events TABLE --output FOLDER
    python -m sedimenta.cli ask --knowledge FOLDER [-q QUESTION] [--mode auto|bm25|vector] [--top-k K] [--embed MODULE:FUNCTION]

Without a question, ask reads questions until an empty line. Defaults come from the environment or a file .env.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import Config, settings
from sedimenta.operators import deps, flows, javaparse, knowledge, report, retrieval, scan, telemetry
from sedimenta.sources import files
from sedimenta.workers import reach

KINDS = ("security", "dependencies", "flows")


def parser(defaults: Config | None = None) -> argparse.ArgumentParser:
    d = defaults or Config()
    top = argparse.ArgumentParser(prog="sedimenta")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse")
    a.add_argument("--repo", required=not d.repo_path, default=d.repo_path or None)
    a.add_argument("--output", required=d.output_path == "output", default=d.output_path)
    a.add_argument("--include-tests", action="store_true", default=d.include_tests)
    a.add_argument("--budget", type=int, default=d.max_tokens_per_chunk)
    a.add_argument("--observations")
    r = sub.add_parser("report")
    r.add_argument("--repo", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--kind", choices=(*KINDS, "all"), default="all")
    t = sub.add_parser("telemetry")
    t.add_argument("--events", required=True)
    t.add_argument("--output", required=True)
    q = sub.add_parser("ask")
    q.add_argument("--knowledge", required=True)
    q.add_argument("-q", "--question")
    q.add_argument("--mode", choices=("auto", "bm25", "vector"), default="auto")
    q.add_argument("--top-k", type=int, default=5)
    q.add_argument("--embed")
    return top


def reports(spark: SparkSession, root: str, kinds: Iterable[str]) -> dict[str, DataFrame]:
    """The rows of each report by the name of its folder."""
    sources = files.read_files(spark, root)
    tables = knowledge.analyse(sources)
    out = {}
    if "security" in kinds:
        tests = files.read_files(spark, root, include_tests=True).where("is_test")
        found = scan.sorted_findings(knowledge.findings(sources, tables, tests))
        out |= {"security/findings": report.finding_rows(found), "security/summary": scan.severity_summary(found)}
    if "dependencies" in kinds:
        matches = deps.dependency_matches(sources)
        out |= {"dependencies/integrations": report.dependency_rows(deps.unique_dependencies(matches)), "dependencies/summary": deps.dependency_summary(matches), "dependencies/tables": report.table_rows(deps.db_tables(sources)), "dependencies/clients": deps.feign_clients(sources).drop("ord")}
    if "flows" in kinds:
        out |= {"flows/endpoints": flows.endpoint_flows(sources, tables["classes"], tables["methods"]), "flows/consumers": deps.consumer_flows(sources).drop("ord")}
    return out


def embedder(name: str | None) -> Callable[[list[str]], list[list[float]]] | None:
    """The function of a module, MODULE:FUNCTION, that gives vectors of texts."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def answer(nodes: DataFrame, question: str, mode: str, k: int, embed: Callable[[list[str]], list[list[float]]] | None) -> str:
    vector = embed([question])[0] if embed and mode != "bm25" else None
    return retrieval.extractive_answer(retrieval.retrieve(nodes, question, mode, k, vector), nodes).first()["answer"]


def run(spark: SparkSession, args: argparse.Namespace, ask: Callable[[], str] = input, say: Callable[[str], None] = print) -> str:
    reach(spark)
    if args.command == "analyse":
        tables = knowledge.analyse(files.read_files(spark, args.repo, include_tests=args.include_tests))
        seen = files.read_json(spark, args.observations, "module string, ord bigint, observation string") if args.observations else None
        knowledge.document(tables, {"repository": args.repo}, args.budget, seen).write.mode("overwrite").text(f"{args.output}/knowledge")
        knowledge.nodes(tables, seen).write.mode("overwrite").parquet(f"{args.output}/nodes")
        knowledge.release(tables)
        return f"written to {args.output}"
    if args.command == "report":
        for name, rows in reports(spark, args.repo, KINDS if args.kind == "all" else (args.kind,)).items():
            files.write_json(rows, f"{args.output}/{name}")
        return f"written to {args.output}"
    if args.command == "telemetry":
        events = spark.read.parquet(args.events)
        files.write_json(telemetry.by_type(events), f"{args.output}/telemetry")
        return f"written to {args.output}"
    nodes, embed = spark.read.parquet(f"{args.knowledge}/nodes"), embedder(args.embed)
    if embed and args.mode != "bm25":
        nodes = retrieval.with_vectors(nodes, embed)
    if args.question:
        return answer(nodes, args.question, args.mode, args.top_k, embed)
    nodes.cache()
    n = 0
    while question := ask().strip():
        say(answer(nodes, question, args.mode, args.top_k, embed))
        n += 1
    nodes.unpersist()
    return f"{n} questions"


def main() -> None:
    args = parser(settings()).parse_args()
    spark = SparkSession.builder.appName("sedimenta").getOrCreate()
    print(run(spark, args))


if __name__ == "__main__":
    main()
