"""What git would list: its binary index, and ignore files inherited by folder.

Every rule of every ignore file is a row (its folder, its place, a pattern, whether it takes back); every file and folder is a
row too. A rule is asked only of what lies below its folder: an equi-join on each of a path's folders. The last rule of the deepest
folder that fits decides, and a path goes if it or any folder above it is ignored, as nothing inside an ignored folder can be taken back.

Spark's own listing passes over names that begin with ``_`` or ``.``, so ``trees`` finds such folders and files by
pattern, one level after the other, and hands them over by name.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of installed dependencies and tools, which are source only where an ignore file takes them back.
DEPENDENCIES = [".git", "node_modules", "vendor/bundle", ".next", ".gradle", ".idea", "__pycache__"]
#: Names of build output, asked only where no git index says what is source.
BUILD_OUTPUT = ["target", "build", "dist", "out", "coverage", "tmp"]

ENTRY = "path string, mode int, stage int, sha string, skip_worktree boolean"


def index_entries(data: bytes, hash_size: int = 20) -> Iterator[tuple[str, int, int, str, bool]]:
    """Path, mode, stage, object and skip mark of each entry of a git index of version 2, 3 or 4."""
    magic, version, count = struct.unpack_from(">4sII", data)
    if magic != b"DIRC" or version not in (2, 3, 4):
        raise ValueError("no git index of version 2, 3 or 4")
    at, name = 12, b""
    for _ in range(count):
        start, mode = at, struct.unpack_from(">I", data, at + 24)[0]
        sha = data[at + 40 : at + 40 + hash_size].hex()
        flags = struct.unpack_from(">H", data, at + 40 + hash_size)[0]
        at += 42 + hash_size
        skip = False
        if flags & 0x4000:  # extended flags
            skip = bool(struct.unpack_from(">H", data, at)[0] & 0x4000)
            at += 2
        if version == 4:  # the name before, shortened, and a suffix
            byte = data[at]
            cut, at = byte & 0x7F, at + 1
            while byte & 0x80:
                byte = data[at]
                cut, at = ((cut + 1) << 7) | (byte & 0x7F), at + 1
            end = data.index(b"\0", at)
            name = name[: len(name) - cut] + data[at:end]
            at = end + 1
        else:
            end = data.index(b"\0", at)
            name = data[at:end]
            at = start + (end - start + 8) // 8 * 8
        yield name.decode("utf-8", "replace"), mode, flags >> 12 & 3, sha, skip


def tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """The entries of ``root``'s git index, one row each; None without one."""
    found = _matching(spark, f"{root.rstrip('/')}/.git/index")
    if not found:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(1):
                rows = list(index_entries(data.as_py()))
                for i in range(0, len(rows), 50_000):
                    part = rows[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()))], ["path", "mode", "stage", "sha", "skip_worktree"])

    return contents(spark, found).select("path", "content").mapInArrow(run, ENTRY)


def pattern(line: str) -> tuple[str, bool, bool] | None:
    """A rule as (regular expression for paths relative to its folder, taken back, folders only); None for comments and empty lines."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    body = line[1:] if back else line
    folder = body.endswith("/")
    body = body.rstrip("/") if folder else body
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i) and i + 2 == len(body) and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
            while body.startswith("*", i):
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            negated = inner[0] in "!^"
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", inner[1:] if negated else inner)
            out, i = out + f"(?!/)[{'^' if negated else ''}{inner}]", end + 1
        else:
            if c == "\\" and i + 1 < len(body):
                i, c = i + 1, body[i + 1]
            out, i = out + (c if c.isalnum() or c in "_/" else "\\" + c), i + 1
    return ("" if anchored else "(?:[^/]+/)*") + out, back, folder


def rules(spark: SparkSession, root: str, ignore_files: DataFrame) -> DataFrame:
    """``dir, depth, line, regex, back, folder``: the rules of ignore files (``path`` relative to the root, ``content``), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = path == ".git/info/exclude"  # below every ignore file of the tree
                folder = "" if low or "/" not in path else path.rpartition("/")[0]
                for n, line in enumerate(data.decode("utf-8-sig", "replace").split("\n")):
                    if made := pattern(line):
                        rows.append((folder, -1 if low else folder.count("/") + bool(folder), n, *made))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], ["dir", "depth", "line", "regex", "back", "folder"])

    return ignore_files.select("path", "content").mapInArrow(run, "dir string, depth int, line int, regex string, back boolean, folder boolean")


def _prefixes(path: Column) -> Column:
    """The path and every folder above it, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def verdicts(paths: DataFrame, known: DataFrame) -> DataFrame:
    """``path, ignored, claimed`` of distinct ``path``s under ``known`` rules; claimed: a rule takes the path, or a folder above it, back."""
    each = paths.select("path").distinct().select("path", F.posexplode(_prefixes(F.col("path"))).alias("at", "node"), F.size(F.split("path", "/")).alias("n"))
    nodes = each.select("node", (F.col("at") + 1 < F.col("n")).alias("is_folder")).distinct()
    above = nodes.select("node", "is_folder", F.explode(F.concat(F.array(F.lit("")), _prefixes(F.col("node")))).alias("dir")).where("dir <> node")
    met = above.join(known, "dir").where("is_folder or not folder").where(F.expr("substring(node, if(dir = '', 1, length(dir) + 2)) rlike concat('^(?:', regex, ')$')"))
    decided = met.groupBy("node", "is_folder").agg(F.max_by("back", F.struct("depth", "line")).alias("back"))
    joined = each.withColumn("is_folder", F.col("at") + 1 < F.col("n")).join(decided, ["node", "is_folder"], "left")
    return joined.groupBy("path").agg(F.coalesce(F.max(~F.col("back")), F.lit(False)).alias("ignored"), F.coalesce(F.max("back"), F.lit(False)).alias("claimed"))


def listed(paths: DataFrame, known: DataFrame, index: DataFrame | None) -> DataFrame:
    """``path, tracked, ignored, source`` of the tree's distinct ``path``s, as git lists them: what isn't ignored, tracked or not.

    A tracked file that a rule ignores was forced past it and is no source. Dependencies are source only where claimed; names of build
    output are asked only without an index.
    """
    judged = verdicts(paths, known)
    if index is None:
        judged = judged.withColumn("tracked", F.lit(False))
    else:
        judged = judged.join(index.select("path", F.lit(True).alias("tracked")).distinct(), "path", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))
    skipped = DEPENDENCIES + ([] if index is not None else BUILD_OUTPUT)
    inside = F.col("path").rlike("(^|/)(" + "|".join(re.escape(x) for x in skipped) + ")/")
    return judged.select("path", "tracked", "ignored", (~F.col("ignored") & (~inside | F.col("claimed"))).alias("source"))


# Names that Spark's listing passes over


def _matching(spark: SparkSession, glob: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [str(s.getPath().toString()) for s in found] if found else []


def _folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory())


def contents(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """``path, length, content`` of named files (of a list, or of a table's only column), read in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for p in b.column(0).to_pylist():
                uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", p))
                system, name = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
                with system.open_input_file(name) as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["path", "length", "content"])

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 64))) if isinstance(paths, list) else paths
    return names.mapInArrow(run, "path string, length long, content binary")


def trees(spark: SparkSession, root: str) -> tuple[DataFrame, list[str]]:
    """``path, length, content`` of all files under ``root``, those of ``_`` names included, and the paths of its ignore files.

    Only such folders' and files' names come to the driver. Folders whose names begin with a dot stay out.
    """
    base = root.rstrip("/")
    folders: list[str] = []
    while True:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([base, *folders])
        depth = raw.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
        levels = range(max(1, depth - base.count("/") + 2))
        hidden = [p for k in levels for p in _matching(spark, base + "/*" * k + "/_*") if not re.search(r"/\.[^/]+/", p[len(base) :])]
        found = [p for p in hidden if _folder(spark, p)]
        if found == folders:
            break
        folders = found
    files = [p for p in hidden if p not in set(folders)]
    if files:
        raw = raw.select("path", "length", "content").unionByName(contents(spark, files))
    ignores = [p for k in levels for p in _matching(spark, base + "/*" * k + "/.gitignore")]
    return raw.select("path", "length", "content"), ignores + _matching(spark, base + "/.git/info/exclude")
