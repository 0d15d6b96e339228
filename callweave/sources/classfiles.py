"""Signatures of library types from class files in archives, only of the names that a project asks for.

Archives are listed first (names of entries alone), joined with the wanted names, and each archive that holds any is opened
once more for these entries. A class file's constant pool, members and ``Signature`` attributes become symbols of a file
``jvm:<type>`` with ``external`` 1; nothing is run.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.names import owner_package
from callweave.plans.scratch import Scratch

PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
#: Bytes of the constants of each tag; text has its own length, and long and double take two places.
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
SYNTHETIC, VARARGS, STATIC, PRIVATE, INTERFACE = 0x1000, 0x80, 0x8, 0x2, 0x200
MEMBER = "fqn string, seq int, kind string, name string, type_name string, type_args string, arity int, params array<string>, modifiers array<string>, supertypes array<string>"


def type_text(s: str, i: int) -> tuple[str, int]:
    """The type written at ``i`` of a descriptor or signature, as source has it, and where it ends."""
    c = s[i]
    if c == "[":
        inner, i = type_text(s, i + 1)
        return inner + "[]", i
    if c == "T":
        end = s.index(";", i)
        return s[i + 1 : end], end + 1
    if c != "L":
        return PRIMITIVES[c], i + 1
    out, i = "", i + 1
    while s[i] != ";":
        if s[i] == "<":
            args, i = [], i + 1
            while s[i] != ">":
                if s[i] == "*":
                    args.append("?")
                    i += 1
                    continue
                bound = {"+": "? extends ", "-": "? super "}.get(s[i], "")
                arg, i = type_text(s, i + bool(bound))
                args.append(bound + arg)
            out += f"<{', '.join(args)}>"
        else:
            out += "." if s[i] in "/$" else s[i]
        i += 1
    return out, i + 1


def method_types(signature: str) -> tuple[list[str], str]:
    """Parameter types and result of a method's descriptor or signature."""
    i, params = signature.index("("), []
    i += 1
    while signature[i] != ")":
        param, i = type_text(signature, i)
        params.append(param)
    return params, type_text(signature, i + 1)[0]


def split_type(text: str) -> tuple[str, str | None]:
    """``a.List<b.C>`` as its name and its arguments."""
    head, found, rest = text.partition("<")
    if not found or not rest.endswith(">"):
        return text.replace(">", "").partition("<")[0] + ("[]" if text.endswith("[]") and "<" in text else ""), None
    return head, rest[:-1]


def class_members(data: bytes) -> Iterator[tuple]:
    """Rows of ``MEMBER``: the type first, then its methods and fields that others can name."""
    magic, _, count = struct.unpack_from(">IIH", data)
    if magic != 0xCAFEBABE:
        raise ValueError("no class file")
    at, pool, k = 10, {}, 1
    while k < count:
        tag = data[at]
        if tag == 1:
            n = struct.unpack_from(">H", data, at + 1)[0]
            pool[k] = data[at + 3 : at + 3 + n].decode("utf-8", "replace")
            at += 3 + n
        else:
            if tag == 7:
                pool[k] = struct.unpack_from(">H", data, at + 1)[0]
            at += 1 + SIZES[tag]
        k += 2 if tag in (5, 6) else 1
    named = lambda i: pool[pool[i]].replace("/", ".").replace("$", ".") if i else None
    access, this, above, n = struct.unpack_from(">HHHH", data, at)
    at += 8
    supertypes = [x for x in (named(above), *(named(i) for i in struct.unpack_from(f">{n}H", data, at))) if x and x != "java.lang.Object"]
    at += 2 * n
    fqn, members = named(this), []
    for kind in ("field", "method"):
        (n,) = struct.unpack_from(">H", data, at)
        at += 2
        for _ in range(n):
            flags, name, descriptor, attributes = struct.unpack_from(">HHHH", data, at)
            at += 8
            text = pool[descriptor]
            for _ in range(attributes):
                what, size = struct.unpack_from(">HI", data, at)
                if pool[what] == "Signature":
                    text = pool[struct.unpack_from(">H", data, at + 6)[0]]
                at += 6 + size
            if not flags & (SYNTHETIC | PRIVATE) and pool[name] != "<clinit>":
                members.append((kind, pool[name], text, flags))
    yield fqn, 0, "interface" if access & INTERFACE else "class", fqn.rpartition(".")[2], None, None, None, None, ["external"], supertypes
    for seq, (kind, name, text, flags) in enumerate(members, 1):
        marks = ["external", *(["static"] if flags & STATIC else [])]
        if kind == "field":
            yield fqn, seq, kind, name, *split_type(type_text(text, 0)[0]), None, None, marks, None
            continue
        params, returns = method_types(text)
        if flags & VARARGS and params:
            params[-1] = params[-1].removesuffix("[]") + "..."
        built = name == "<init>"
        yield fqn, seq, "constructor" if built else "method", fqn.rpartition(".")[2] if built else name, *((None, None) if built else split_type(returns)), len(params), [p if p.endswith("...") else split_type(p)[0] for p in params], marks, None


def wanted_types(files: DataFrame, symbols: DataFrame, imports: DataFrame, locals_: DataFrame) -> DataFrame:
    """``fqn``: what the project's Java files import, or name without an import, and don't declare."""
    own = files.where("lang = 'java' and external = 0").select(F.col("id").alias("file_id"))
    declared = symbols.where("fqn is not null").select("fqn").distinct()
    said = imports.join(own, "file_id", "left_semi").where("is_wildcard = 0")
    imported = said.select(F.when(F.col("is_static") == 1, F.regexp_replace("fqn", r"\.[^.]*$", "")).otherwise(F.col("fqn")).alias("fqn"))
    used = locals_.join(own, "file_id", "left_semi").select("type_name").unionByName(symbols.join(own, "file_id", "left_semi").select("type_name")).where("type_name is not null").distinct()
    bare = used.select(F.regexp_replace("type_name", r"(\[\]|\.\.\.)+$", "").alias("name"))
    implicit = bare.where(F.col("name").rlike("^[A-Z][A-Za-z0-9_$]*$")).select(F.concat(F.lit("java.lang."), "name").alias("fqn"))
    head = F.substring_index("name", ".", 1)
    nested = bare.where("name like '%.%'").withColumn("simple", head).join(said.where("is_static = 0").select("simple", F.col("fqn").alias("outer")).distinct(), "simple").select(F.concat("outer", F.expr("substring(name, length(simple) + 1)")).alias("fqn"))
    always = files.sparkSession.createDataFrame([("java.lang.Object",), ("java.lang.String",)], "fqn string")
    return imported.unionByName(implicit).unionByName(nested).unionByName(always).distinct().join(declared, "fqn", "left_anti")


def _archive(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data[4:] if data[:2] == b"JM" else data))  # module archives have four bytes before


def signatures(spark: SparkSession, archives: list[str], wanted: DataFrame) -> DataFrame:
    """``MEMBER`` rows of ``wanted(fqn)`` types; of several archives that hold a type, the first by name is read. Damaged archives and entries hold none."""
    raw = spark.read.format("binaryFile").load(archives).select("path", "content")
    names = ["path", "entry", "fqn"]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    found = [n for n in _archive(data.as_py()).namelist() if n.endswith(".class") and not n.startswith("META-INF/")]
                except zipfile.BadZipFile:
                    continue
                fqns = [n.removeprefix("classes/")[:-6].replace("/", ".").replace("$", ".") for n in found]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(fqns, pa.string())], names)

    listed = raw.mapInArrow(entries, "path string, entry string, fqn string").join(wanted, "fqn")
    chosen = listed.groupBy("fqn").agg(F.min_by("entry", "path").alias("entry"), F.min("path").alias("path"))
    asked = chosen.groupBy("path").agg(F.collect_list("entry").alias("entries"))  # at most an archive's own
    columns = [c.split()[0] for c in MEMBER.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.list_(pa.string())] * 3]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                archive = _archive(data.as_py())
                for entry in wanted:
                    try:
                        rows = list(class_members(archive.read(entry)))
                    except (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile):
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], columns)

    return raw.join(asked, "path").select("content", "entries").mapInArrow(members, MEMBER)


def read(spark: SparkSession, archives: list[str], f: dict[str, DataFrame], repo_id: str) -> dict[str, DataFrame]:
    """``files`` and ``symbols`` of the library types that the facts ``f`` ask for, in their columns."""
    scratch = Scratch(spark)
    rows = scratch.save(signatures(spark, archives, wanted_types(f["files"], f["symbols"], f["imports"], f["locals"])))
    path = F.concat(F.lit("jvm:"), "fqn")
    file_id = F.xxhash64(F.lit(repo_id), F.lit("file"), path)
    place = F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(F.lit(repo_id), path, F.lit("symbols")), F.lit(20)), F.lit(20))
    known = {"id": file_id, "path": path, "lang": F.lit("java"), "hash": F.lit(""), "pkg": F.regexp_replace("fqn", r"\.[^.]*$", ""), "lines": F.lit(0), "external": F.lit(1), "owner": owner_package("fqn")}
    files = rows.where("seq = 0").select(*[known[c].alias(c) for c in f["files"].columns])
    typed = F.col("seq") == 0
    made = {
        "id": place + F.col("seq"), "file_id": file_id, "fqn": F.when(typed, F.col("fqn")).otherwise(F.concat_ws(".", "fqn", "name")), "container_fqn": F.when(~typed, F.col("fqn")),
        "signature": F.concat_ws(" ", "type_name", F.concat("name", F.lit("("), F.coalesce(F.array_join("params", ", "), F.lit("")), F.lit(")"))), "start_line": F.lit(0), "end_line": F.lit(0), "start_byte": F.lit(0), "end_byte": F.lit(0), "annotations": F.array().cast("array<string>"),
    }
    symbols = rows.select(*[made.get(c, F.col(c)).alias(c) for c in f["symbols"].columns])
    return {"files": scratch.save(files), "symbols": scratch.save(symbols)}
