"""Command line over a stored index: ``python -m callweave.cli COMMAND STORE [REPO] ...``; ``--json`` prints rows as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import project, report
from callweave.operators import cycles, endpoints, graph, insight, relations, routing, search, stats

LIMIT = 50


def located(facts: dict[str, DataFrame], name: str) -> int:
    """The one symbol that a name means; a tie is an error that names its candidates."""
    rows = search.best_match(relations.located(facts["symbols"], facts["files"], own_only=True), name).collect()
    if not rows:
        raise SystemExit(f"nothing is called {name!r}")
    if len(rows) > 1:
        raise SystemExit(search.ambiguity_note(name, [(r["fqn"] or r["name"], r["file_path"], r["start_line"]) for r in rows]))
    return rows[0]["id"]


def answer(spark: SparkSession, args: argparse.Namespace) -> tuple[list, list[str], int]:
    """Rows, their columns and the exit code."""
    if args.command == "index":
        facts = project.index(spark, args.args[0], repo_id=args.repo)
        project.write(facts, args.store, args.repo)
        return [{"table": n, "rows": project.read(spark, args.store, args.repo)[n].count()} for n in project.NAMES], ["table", "rows"], 0
    f = project.read(spark, args.store, args.repo)
    bindings = endpoints.collected(f)
    edges = f["edges"].unionByName(endpoints.wired(bindings))
    symbols, files = f["symbols"], f["files"]
    own = relations.located(symbols, files, own_only=True)
    code = 0
    match args.command:
        case "status":
            out = stats.resolution(stats.project_stats(files, symbols, f["types"], f["edges"], f["refs"], f["unresolved"]))
        case "query":
            out = search.search(own, args.args[0]).select("score", "fqn", "kind", "file_path", "start_line")
        case "callers":
            out = relations.callers(edges, symbols, files).where(F.col("of_id") == located(f, args.args[0])).select("fqn", "edge_kind", "confidence", "via", "lines", "file_path").orderBy(F.desc("confidence"), "fqn")
        case "callees":
            out = relations.callees(edges, symbols, files).where(F.col("of_id") == located(f, args.args[0])).select("fqn", "edge_kind", "confidence", "via", "lines", "file_path").orderBy("fqn")
        case "why":
            out = insight.explained(edges, f["refs"], f["unresolved"]).where(F.col("id") == located(f, args.args[0])).select("side", "tier", "n").orderBy("side", "tier")
        case "impact":
            at = located(f, args.args[0])
            out = graph.reached(edges, spark.range(1).select(F.lit(at).alias("seed"), F.lit(at).alias("id"))).join(own.select("id", "fqn", "file_path"), "id").select("depth", "fqn", "file_path").orderBy("depth", "fqn")
        case "affected":
            paths = spark.createDataFrame([(p,) for p in report.changed_paths(args.args or sys.stdin.read().split("\n"), args.root)], "path string")
            out = graph.affected(edges, symbols, files, paths).select("path", "is_test", "depth").distinct().orderBy("is_test", "path")
            tests = out.where("is_test").count()
            code = 2 if args.fail_if_untested and graph.untested(symbols.join(files.join(paths, "path", "left_semi").select(F.col("id").alias("file_id")), "file_id", "left_semi").count(), tests) else 0
        case "path":
            hops = graph.path_between(edges, relations.members(symbols), located(f, args.args[0]), located(f, args.args[1]))
            names = {r["id"]: r["fqn"] for r in own.where(F.col("id").isin([h["id"] for h in hops or []])).select("id", "fqn").collect()}
            return [h | {"fqn": names.get(h["id"])} for h in hops or []], ["fqn", "kind", "via"], 0 if hops is not None else 1
        case "dead":
            out = insight.shown_dead_code(insight.dead_code(edges, bindings, symbols, files, f["refs"], f["unresolved"]), LIMIT, not args.public).select("confidence", "fqn", "file_path", "start_line")
        case "cycles":
            out = cycles.rings(relations.file_edges(edges, symbols, files)).orderBy("length", "ring").limit(LIMIT)
        case "hotspots":
            out = insight.top_hotspots(edges, symbols, files).select("callers", "caller_files", "fqn", "file_path")
        case "routes":
            out = routing.routes(bindings.withColumn("id", F.xxhash64("plugin", "role", "key", "symbol_id", "line")), symbols, files).orderBy("key")
        case _:
            raise SystemExit(f"no command {args.command!r}")
    return [r.asDict() for r in out.collect()], out.columns, code


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="callweave", description=__doc__)
    parser.add_argument("command")
    parser.add_argument("store")
    parser.add_argument("repo")
    parser.add_argument("args", nargs="*")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--public", action="store_true", help="dead: what other projects may call, too")
    parser.add_argument("--root", default="", help="affected: the indexed folder, for absolute paths")
    parser.add_argument("--fail-if-untested", action="store_true", help="affected: exit 2 if no test reaches the change")
    args = parser.parse_args(argv)
    rows, columns, code = answer(SparkSession.builder.appName("callweave").getOrCreate(), args)
    print(json.dumps(rows, default=str) if args.json else report.table_text(rows, columns))
    return code


if __name__ == "__main__":
    sys.exit(main())
