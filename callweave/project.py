"""A source tree to a stored index, and the index as fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.extract import facts, raw_facts
from callweave.operators.relations import types_view
from callweave.operators.resolve import Java, Ruby
from callweave.operators.resolve_script import Script
from callweave.plans.scratch import Scratch
from callweave.schema import SCHEMA_VERSION, TABLES
from callweave.sources import ambient, classfiles
from callweave.sources.files import read_tree
from callweave.sources.modules import workspace
from callweave.streaming.sync import compared

RESOLVERS = {
    ("java",): lambda f, root: Java(f["files"], f["symbols"], f["imports"], f["locals"], f["refs"]).resolved(),
    ("ruby",): lambda f, root: Ruby(f["symbols"], f["locals"], f["refs"]).resolved(),
    ("typescript", "tsx", "javascript"): lambda f, root: Script(f["files"], f["symbols"], f["imports"], f["locals"], f["refs"], *_workspace(f, root)).resolved(),
}
NAMES = ["files", "symbols", "types", "imports", "locals", "refs", "edges", "unresolved"]


EXTRACTED = ["symbols", "imports", "locals", "refs"]


def _workspace(f: dict[str, DataFrame], root: str) -> tuple[DataFrame, DataFrame]:
    """Aliases and packages; a package of the workspace comes before a dependency of its name."""
    alias, packages = workspace(f["files"].sparkSession, root)
    if "entries" in f:
        packages = packages.unionByName(f["entries"].join(packages.select("name"), "name", "left_anti"))
    return alias, packages


def _with_libraries(spark: SparkSession, out: dict[str, DataFrame], root: str, repo_id: str, archives: list[str] = ()) -> dict[str, DataFrame]:
    """The facts with those of the declarations that scripts import, and of the types in ``archives`` that Java files name; a path that the project has stays its own."""
    if archives:
        known = classfiles.read(spark, list(archives), out, repo_id)
        out = out | {n: out[n].unionByName(df) for n, df in known.items()}
    scripts = out["files"].where(F.col("lang").isin("typescript", "tsx", "javascript")).select(F.col("id").alias("file_id"))
    known = ambient.read(spark, root, out["imports"].join(scripts, "file_id", "left_semi"), repo_id)
    if known is None:
        return out
    library, entries = known
    new = library["files"].join(out["files"].select("path"), "path", "left_anti")
    kept = new.select(F.col("id").alias("file_id"))
    more = {"files": new} | {n: library[n].join(kept, "file_id", "left_semi") for n in ambient.KEPT}
    return out | {n: out[n].unionByName(df.select(out[n].columns)) for n, df in more.items()} | {"entries": entries}


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType([f for f in TABLES[name].fields if f.name != "repo_id"]))


def index(spark: SparkSession, root: str, repo_id: str, rules: list[str] = (), archives: list[str] = ()) -> dict[str, DataFrame]:
    """Reads, extracts and resolves every admitted file under ``root``; ids follow from ``repo_id``, which ``write`` and ``sync`` must be given too.

    ``archives`` are the class path: jars or module archives whose types the sources name.
    """
    scratch = Scratch(spark)
    files = scratch.save(read_tree(spark, root, list(rules)).where("admission = 'ok'"))
    return _resolved(spark, _with_libraries(spark, facts(files, scratch.save(raw_facts(files)), repo_id), root, repo_id, archives), root)


def _resolved(spark: SparkSession, out: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    out["types"] = types_view(out["symbols"])
    edges, unresolved = [], []
    for langs, resolver in RESOLVERS.items():  # languages don't see each other's names
        own = out["files"].where(F.col("lang").isin(*langs))
        if own.isEmpty():
            continue
        part = {n: out[n].join(own.select(F.col("id").alias("file_id")), "file_id", "left_semi") for n in EXTRACTED}
        for rows, made in zip((edges, unresolved), resolver(part | {"files": own} | ({"entries": out["entries"]} if "entries" in out else {}), root), strict=True):
            rows.append(made)
    out["edges"] = reduce(DataFrame.unionByName, edges) if edges else _empty(spark, "edges")
    out["unresolved"] = reduce(DataFrame.unionByName, unresolved) if unresolved else _empty(spark, "unresolved")
    return {n: out[n] for n in NAMES}


def sync(spark: SparkSession, root: str, folder: str, repo_id: str, rules: list[str] = (), archives: list[str] = ()) -> dict[str, int]:
    """Brings a stored repository in step with its tree: only new and changed files are read again, gone ones lose their facts.

    Ids follow from path and place, so facts of unchanged files stay as stored. Resolution runs anew over all facts, since a new
    declaration may change what any call means. Returns the number of files of each status; nothing is written if none changed.
    """
    scratch = Scratch(spark)
    listed = read_tree(spark, root, list(rules)).where("admission = 'ok'")
    stored = read(spark, folder, repo_id)
    stored["files"] = stored["files"].where("external = 0")  # libraries are read anew, by what is imported
    status = scratch.save(compared(stored["files"], listed))
    counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if set(counts) <= {"unchanged"}:
        return counts
    kept = status.where("status = 'unchanged'").select("path")
    same = scratch.save(stored["files"].join(kept, "path", "left_semi"))
    files = scratch.save(listed.join(status.where("status in ('added', 'changed')").select("path"), "path", "left_semi"))
    fresh = facts(files, scratch.save(raw_facts(files)), repo_id)
    out = {"files": scratch.save(same.select(fresh["files"].columns).unionByName(fresh["files"]))}
    for name in EXTRACTED:
        old = stored[name].join(same.select(F.col("id").alias("file_id")), "file_id", "left_semi")
        out[name] = scratch.save(old.select(fresh[name].columns).unionByName(fresh[name]))
    write({n: scratch.save(df) for n, df in _resolved(spark, _with_libraries(spark, out, root, repo_id, archives), root).items()}, folder, repo_id)
    return counts


def write(tables: dict[str, DataFrame], folder: str, repo_id: str) -> None:
    """Stores a repository's facts: one partition a repository in each table, replaced as a whole; the schema version is in the path."""
    for name, df in tables.items():
        known = {f.name: f.dataType for f in TABLES[name].fields}
        full = df.select(*[(F.lit(repo_id) if c == "repo_id" else F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in known.items()])
        full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{folder}/v{SCHEMA_VERSION}/{name}")


def read(spark: SparkSession, folder: str, repo_id: str | None = None) -> dict[str, DataFrame]:
    """The stored facts of one repository, without ``repo_id``, or of all; a folder of another schema version has none."""
    out = {}
    for name in NAMES:
        df = spark.read.schema(TABLES[name]).parquet(f"{folder}/v{SCHEMA_VERSION}/{name}")
        out[name] = df.where(F.col("repo_id") == repo_id).drop("repo_id") if repo_id else df
    return out


def mermaid(nodes: list[tuple[int, str, str]], edges: list[tuple[int, int, str]], truncated: bool = False) -> str:
    """A flowchart of an answer that is small already: (id, label, kind) and (from, to, label)."""
    shape = lambda kind: ('(["', '"])') if kind in ("class", "interface", "enum", "record", "module") else ('["', '"]')
    lines = ["flowchart LR"]
    for i, label, kind in nodes:
        a, b = shape(kind)
        lines.append(f"  n{i}{a}{label.replace(chr(34), '#quot;')}{b}")
    lines += [f"  n{a} -->|{label}| n{b}" for a, b, label in edges]
    return "\n".join([*lines, *(["  %% more nodes were left out"] if truncated else [])])
