"""Declarations of imported packages: ``.d.ts`` files under ``node_modules``, read as files of a library.

One listing of the dependency folders (paths and sizes, no contents) is joined with the names that the project imports. A package's home
is its own folder, of several that of the nearest ``node_modules``, else its ``@types`` one. Its manifest names the entry; the declarations beside and below the
entry belong to it. What their imports name is asked in the next round, one join a round, ``hops`` rounds.
"""

from __future__ import annotations

import json
import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.extract import facts, raw_facts
from callweave.plans.scratch import Scratch
from callweave.sources.ignores import _matching, contents

#: Files a package, bytes a file, folders below the entry, folders above a ``node_modules``.
MAX_FILES, MAX_BYTES, MAX_DEPTH, MAX_ABOVE = 120, 1_500_000, 3, 3
KEPT = ("symbols", "imports")


def package_of(specifier: Column) -> Column:
    """``@scope/name`` or ``name`` of what an import says; null for paths."""
    return F.when(~F.col("specifier").startswith(".") & (specifier != ""), F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1)))


def _types_entry(manifest: str | None) -> str | None:
    try:
        said = json.loads(manifest or "")
        entry = said.get("types") or said.get("typings")
    except (ValueError, AttributeError):
        return None
    return posixpath.normpath(entry) if isinstance(entry, str) else None


def listing(spark: SparkSession, root: str) -> DataFrame | None:
    """``uri, path, home, package, nearness, rest, length`` of manifests and declarations under the tree's dependency folders."""
    base = root.rstrip("/")
    folders = [p for k in range(MAX_ABOVE + 1) for p in _matching(spark, base + "/*" * k + "/node_modules")]
    folders = [p for p in folders if "/node_modules/" not in p]
    folders += _matching(spark, base + "/node_modules/.pnpm/node_modules")
    if not folders:
        return None
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.d.ts,package.json}").load(folders)
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    path = F.substring(bare("path"), F.length(bare(F.lit(base))) + 2, F.lit(1 << 30))
    rows = raw.select(F.col("path").alias("uri"), path.alias("path"), "length")
    store = F.col("path").startswith("node_modules/.pnpm/node_modules/")
    at = rows.select("*", F.when(store, "node_modules/.pnpm/node_modules").otherwise(F.regexp_extract("path", "^(.*?node_modules)/", 1)).alias("folder"), F.when(store, F.lit(1 << 20)).otherwise(F.size(F.split(F.regexp_extract("path", "^(.*?)node_modules/", 1), "/"))).alias("nearness"))
    rest = F.expr("substring(path, length(folder) + 2)")
    named = at.withColumn("specifier", rest).withColumn("package", package_of(F.col("specifier")))
    inner = F.expr("substring(specifier, length(package) + 2)")
    # a package's own node_modules is another's
    return named.select("uri", "path", F.concat_ws("/", "folder", "package").alias("home"), "package", "nearness", inner.alias("rest"), "length").where("rest <> '' and not rest like '%node_modules/%'")


def declarations(found: DataFrame, wanted: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """``owner, uri, path`` of the declarations of the packages ``wanted(name)``, and ``name, entry`` of those that have any."""
    spark = found.sparkSession
    types = F.concat(F.lit("@types/"), F.replace(F.regexp_replace("name", "^@", ""), F.lit("/"), F.lit("__")))
    asked = wanted.select("name", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("name").alias("package")), F.struct(F.lit(1).alias("turn"), types.alias("package")))).alias("p")).select("name", "p.turn", "p.package")
    homes = asked.join(found.select("package", "home", "nearness").distinct(), "package").groupBy("name").agg(F.min_by("home", F.struct("turn", "nearness", "home")).alias("home"))
    own = found.join(homes, "home")
    manifests = own.where("rest = 'package.json'").select("name", "uri")
    read = contents(spark, manifests.select("uri").distinct()).select(F.col("path").alias("uri"), F.col("content").cast("string").alias("manifest"))
    said = manifests.join(read, "uri").select("name", F.udf(_types_entry, "string")("manifest").alias("said"))
    files = own.where("rest like '%.d.ts'").where(F.col("length") <= max_bytes).join(said, "name", "left")
    entries = files.where(F.col("rest").isin("index.d.ts") | (F.col("rest") == F.col("said"))).groupBy("name").agg(F.max_by("rest", (F.col("rest") == F.coalesce("said", F.lit(""))).cast("int")).alias("entry_file"), F.first("home").alias("h"))
    beside = files.join(entries, "name").withColumn("base", F.regexp_replace("entry_file", "[^/]*$", "")).where("startswith(rest, base)")
    depth = F.size(F.split(F.expr("substring(rest, length(base) + 1)"), "/")) - 1
    first = F.row_number().over(Window.partitionBy("name").orderBy((F.col("rest") != F.col("entry_file")).cast("int"), "depth", "rest"))  # files of one package
    chosen = beside.withColumn("depth", depth).where(F.col("depth") <= max_depth).withColumn("n", first).where(F.col("n") <= max_files)
    return chosen.select(F.col("name").alias("owner"), "uri", "path"), entries.select("name", F.concat_ws("/", "h", "entry_file").alias("entry"))


def read(spark: SparkSession, root: str, imports: DataFrame, repo_id: str, hops: int = 1) -> tuple[dict[str, DataFrame], DataFrame] | None:
    """The files, symbols and imports of what ``imports`` need, with ``external`` 1 and the package as ``owner``, and ``name, entry``; None without dependencies.

    Calls inside a library are none of the project's, so they aren't kept. Ids follow from the path without its ``.d``, which names the module.
    """
    found = listing(spark, root)
    if found is None:
        return None
    scratch = Scratch(spark)
    found = scratch.save(found)
    wanted = scratch.save(_packages(imports))
    done: DataFrame | None = None
    parts, entries = [], []
    for _ in range(hops):
        if wanted.isEmpty():
            break
        chosen, named = (scratch.save(df) for df in declarations(found, wanted))
        # a file that two packages share is read for the first
        chosen = chosen.groupBy("uri", "path").agg(F.min("owner").alias("owner"))
        texts = contents(spark, chosen.select("uri")).select(F.col("path").alias("uri"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        files = scratch.save(chosen.join(texts, "uri").select(F.regexp_replace("path", r"\.d\.ts$", ".ts").alias("path"), F.lit("typescript").alias("lang"), "text", F.sha1("text").alias("hash"), (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), "owner"))
        made = facts(files.drop("owner"), scratch.save(raw_facts(files)), repo_id)
        owners = files.select("path", F.col("owner").alias("library"))
        outside = made["files"].join(owners, "path").withColumns({"external": F.lit(1), "owner": F.col("library"), "path": F.regexp_replace("path", r"\.ts$", ".d.ts")}).select(made["files"].columns)
        parts.append({"files": scratch.save(outside)} | {n: scratch.save(made[n]) for n in KEPT})
        entries.append(named)
        done = wanted if done is None else done.unionByName(wanted)
        wanted = scratch.save(_packages(parts[-1]["imports"]).join(done, "name", "left_anti"))
    if not parts:
        return None
    whole = {n: reduce(DataFrame.unionByName, [p[n] for p in parts]).dropDuplicates(["id"]) for n in ("files", *KEPT)}
    return whole, reduce(DataFrame.unionByName, entries)


def _packages(imports: DataFrame) -> DataFrame:
    said = imports.where("kind in ('import', 'reexport')").select(F.col("fqn").alias("specifier"))
    return said.select(package_of(F.col("specifier")).alias("name")).where("name is not null").distinct()
