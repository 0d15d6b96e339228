"""SQL mapper files: statements in XML become symbols, joined with the interface methods that run them.

A mapper's texts are read as one stream of marks: comments are blanked first, keeping every offset and line, and all offsets of
a file find their lines by one sorted search among its line starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The elements that hold a statement.
VERBS = ["select", "insert", "update", "delete"]
FOUND = "file_id long, namespace string, name string, verb string, start_byte int, end_byte int, start_line int, end_line int"
TAG = re.compile(r"<\s*(/?)\s*([A-Za-z][\w.-]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
CONFIDENCE, KIND, VIA = 0.95, "implemented-by", "binding:mybatis"


def blanked(text: str, opening: str, closing: str) -> str:
    """``text`` with what lies between the marks, and they, turned to blanks; line breaks and all offsets stay. One that isn't closed stays as it is."""
    out, done = [], 0
    while (at := text.find(opening, done)) >= 0 and (end := text.find(closing, at + len(opening))) >= 0:
        end += len(closing)
        out += [text[done:at], re.sub(r"[^\n]", " ", text[at:end])]
        done = end
    return "".join([*out, text[done:]])


def lines_at(text: str, offsets: list[int]) -> list[int]:
    """The line, from 1, of each offset."""
    breaks = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    return (np.searchsorted(breaks, np.array(offsets, np.int64), "left") + 1).tolist()


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] for m in ATTRIBUTE.finditer(text)}


def read_mapper(text: str) -> list[tuple[str, str, str, int, int]]:
    """(namespace, id, verb, start, end) of a mapper file's statements; none for other files. A statement ends with its verb's next closing tag, else with its own."""
    tags = list(TAG.finditer(blanked(text, "<!--", "-->")))
    namespace = next((_attributes(m[3]).get("namespace") for m in tags if not m[1] and m[2].lower() == "mapper"), None)
    if not namespace:
        return []
    ends: dict[str, int] = {}
    out = []
    for m in reversed(tags):
        verb = m[2].lower()
        if verb in VERBS:
            if m[1]:
                ends[verb] = m.end()
            elif name := _attributes(m[3]).get("id"):
                out.append((namespace, name, verb, m.start(), ends.get(verb, m.end())))
    return out[::-1]


def statements(files: DataFrame) -> DataFrame:
    """The statements of ``files(id, text)``, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 4]
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = read_mapper(text or "")
                places = lines_at(text or "", [o for r in found for o in r[3:]])
                rows += [(key, *r, *places[2 * i : 2 * i + 2]) for i, r in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return files.select("id", "text").mapInArrow(run, FOUND)


def statement_symbols(found: DataFrame) -> DataFrame:
    """Symbols named ``sql:namespace#id``, of kind ``sql-statement``; a repeated statement of a file is one for each place."""
    return found.select(
        F.xxhash64(F.lit("sql"), "file_id", "start_byte").alias("id"),
        "file_id",
        "name",
        F.concat(F.lit("sql:"), "namespace", F.lit("#"), "name").alias("fqn"),
        F.lit("sql-statement").alias("kind"),
        F.col("namespace").alias("container_fqn"),
        F.concat(F.lit("<"), "verb", F.lit(' id="'), "name", F.lit('">')).alias("signature"),
        "start_line",
        "end_line",
        "start_byte",
        "end_byte",
        F.array("verb").alias("annotations"),
    )


def mapped(found: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bindings, edges)``: statements as providers, methods of a type that a mapper names as consumers, and an edge from each method to the statements of its name."""
    made = statement_symbols(found)
    key = lambda a: F.concat(a, F.lit("#"), "name")
    row = lambda rows, role: rows.select("file_id", F.col("id").alias("symbol_id"), F.lit("mybatis").alias("plugin"), F.lit(role).alias("role"), key("container_fqn").alias("key"), F.col("start_line").alias("line"))
    methods = symbols.where("kind = 'method'").join(found.select(F.col("namespace").alias("container_fqn")).distinct(), "container_fqn", "left_semi")
    ends = made.select("container_fqn", "name", F.col("id").alias("to_symbol_id"))
    met = methods.select("container_fqn", "name", F.col("id").alias("from_symbol_id"), F.col("start_line").alias("line")).join(ends, ["container_fqn", "name"])
    edges = met.select("from_symbol_id", "to_symbol_id", F.lit(KIND).alias("kind"), F.lit(CONFIDENCE).alias("confidence"), F.lit(VIA).alias("via"), "line")
    return row(made, "provider").unionByName(row(methods, "consumer")), edges
