"""JavaScript workspaces: path aliases, packages, and module resolution as prioritised joins."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.plans.scratch import Scratch

#: The manifest fields that name a package's entry, in order.
ENTRY_FIELDS = ["types", "typings", "module", "main"]


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas, made JSON."""
    bare = re.sub(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.DOTALL)
    return re.sub(r"(\"(?:\\.|[^\"\\])*\")|,(\s*[}\]])", lambda m: m[1] or m[2], bare)


def compiler_options(configs: dict[str, str], path: str, depth: int = 2) -> dict:
    """A config's options over those that it extends; ``configs`` maps path to text."""
    try:
        said = json.loads(without_comments(configs[path]))
    except (KeyError, ValueError):
        return {}
    folder, base = posixpath.dirname(path), {}
    parent = said.get("extends")
    if isinstance(parent, str) and parent.startswith(".") and depth:
        above = posixpath.normpath(posixpath.join(folder, parent))
        base = compiler_options(configs, above if above.endswith(".json") else above + ".json", depth - 1)
    own = dict(said.get("compilerOptions") or {})
    if "baseUrl" in own:
        own["baseUrl"] = posixpath.normpath(posixpath.join(folder, own["baseUrl"]))
    if "paths" in own:
        own["pathsFrom"] = own.get("baseUrl", folder)
    return base | own


def aliases(options: dict) -> list[tuple[str, str, int]]:
    """(prefix, target, order) of each path pattern, the longest prefix first; an exact pattern keeps its whole name."""
    rows = []
    for pattern, targets in (options.get("paths") or {}).items():
        for at, target in enumerate(targets):
            rows.append((pattern, posixpath.normpath(posixpath.join(options.get("pathsFrom") or ".", target)), at))
    return [(p.rstrip("*"), t.rstrip("*"), i) for i, (p, t, _) in enumerate(sorted(rows, key=lambda r: (-len(r[0]), r[2])))]


def workspace(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``alias`` and ``packages`` of the configurations and manifests under ``root``; these few small texts are read on the driver."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{tsconfig,jsconfig,package}*.json").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    rel = F.substring(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.length(base) + 2, F.lit(1 << 30))
    own = raw.select(rel.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(~F.col("path").rlike("(^|/)node_modules/"))
    texts = {r["path"]: r["text"] for r in own.collect()}
    rules = sorted({a for p in texts if posixpath.basename(p)[:2] in ("ts", "js") for a in aliases(compiler_options(texts, p))})
    named = sorted({e for p, t in texts.items() if posixpath.basename(p) == "package.json" and (e := package_entry(t, posixpath.dirname(p)))})
    return spark.createDataFrame(rules, "prefix string, target string, at int"), spark.createDataFrame(named, "name string, entry string")


def export_entry(exports) -> str | None:
    """The file that a package's ``exports`` gives for the package itself."""
    if isinstance(exports, str):
        return exports
    if isinstance(exports, list):
        return next((e for x in exports if (e := export_entry(x))), None)
    if isinstance(exports, dict):
        for key in (".", "types", "import", "module", "require", "default", "node", "browser"):
            if key in exports and (found := export_entry(exports[key])):
                return found
    return None


def package_entry(manifest: str, folder: str) -> tuple[str, str] | None:
    """(name, entry module) of a package manifest."""
    try:
        said = json.loads(manifest)
    except ValueError:
        return None
    if not isinstance(said, dict) or not said.get("name"):
        return None
    entry = next((said[f] for f in ENTRY_FIELDS if isinstance(said.get(f), str)), None) or export_entry(said.get("exports")) or "index"
    return said["name"], posixpath.normpath(posixpath.join(folder, entry))


def _normal(path: Column) -> Column:
    """``a/./b/../c`` to ``a/c``: parts folded from left to right."""
    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when((part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved_modules(imports: DataFrame, modules: DataFrame, alias: DataFrame, packages: DataFrame) -> DataFrame:
    """``from_module, specifier`` to ``module``: relative paths, then aliases, then workspace packages; of each the first probe that exists.

    ``modules`` has ``module`` (a path without extension); ``alias`` ``prefix, target, at``; ``packages`` ``name, entry``.
    """
    asked = imports.select("from_module", "specifier").distinct()
    folder = F.regexp_replace("from_module", "[^/]*$", "")
    relative = asked.where(F.col("specifier").startswith(".")).select("from_module", "specifier", F.lit(0).alias("rule"), _normal(F.concat(folder, "specifier")).alias("path"))
    bare = asked.where(~F.col("specifier").startswith("."))
    # every beginning of a specifier against the prefixes, by equality; only lengths that some prefix has
    lengths = alias.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    begun = bare.crossJoin(F.broadcast(lengths)).select("from_module", "specifier", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("specifier"))
    met = begun.withColumn("prefix", F.expr("substring(specifier, 1, n)")).join(alias, "prefix")
    by_alias = met.select("from_module", "specifier", (F.lit(100) + F.col("at")).alias("rule"), _normal(F.concat("target", F.expr("substring(specifier, length(prefix) + 1)"))).alias("path"))
    name = F.when(F.col("specifier").startswith("@"), F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
    by_package = bare.withColumn("name", name).join(packages, "name")
    inside = F.when(F.col("specifier") == F.col("name"), F.col("entry")).otherwise(F.concat(F.regexp_replace("entry", "[^/]*$", ""), F.expr("substring(specifier, length(name) + 2)")))
    by_package = by_package.select("from_module", "specifier", F.lit(1000).alias("rule"), _normal(inside).alias("path"))
    tried = relative.unionByName(by_alias).unionByName(by_package)
    bare_path = F.regexp_replace(F.regexp_replace("path", r"\.d\.(ts|mts|cts)$", ""), r"\.(tsx?|jsx?|mts|cts|mjs|cjs)$", "")
    options = F.array(F.struct(F.lit(0).alias("probe"), bare_path.alias("module")), F.struct(F.lit(1).alias("probe"), F.col("path").alias("module")), F.struct(F.lit(2).alias("probe"), F.concat("path", F.lit("/index")).alias("module")))
    each = tried.select("from_module", "specifier", "rule", F.explode(options).alias("o")).select("from_module", "specifier", "rule", "o.probe", "o.module")
    return each.join(modules.select("module").distinct(), "module").groupBy("from_module", "specifier").agg(F.min(F.struct("rule", "probe", "module"))["module"].alias("module"))


def exported(direct: DataFrame, reexports: DataFrame) -> DataFrame:
    """``module, name, origin``: every exported name and the module that declares it, through re-exports and their cycles.

    ``direct`` has ``module, name`` and, if the origin is to be more than the module, ``origin``; ``reexports`` has ``module, from_module, name, orig`` with ``name`` ``*`` for all.
    Each round is one join; a pair is taken once, its least origin in the nearest round.
    """
    scratch = Scratch(direct.sparkSession)
    seen = frontier = scratch.save(direct.groupBy("module", "name").agg(F.min("origin" if "origin" in direct.columns else "module").alias("origin")))
    while not frontier.isEmpty():
        star = reexports.where("name = '*'").select(F.col("module").alias("outer"), F.col("from_module").alias("module")).join(frontier, "module").where("name <> 'default'").select(F.col("outer").alias("module"), "name", "origin")
        named = reexports.where("name <> '*'").select(F.col("module").alias("outer"), F.col("from_module").alias("module"), F.col("name").alias("as"), F.col("orig").alias("name")).join(frontier, ["module", "name"]).select(F.col("outer").alias("module"), F.col("as").alias("name"), "origin")
        found = star.unionByName(named).groupBy("module", "name").agg(F.min("origin").alias("origin"))
        frontier = scratch.save(found.join(seen.select("module", "name"), ["module", "name"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen
