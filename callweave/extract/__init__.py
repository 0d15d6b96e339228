"""Source text to fact rows: one extractor per language, run in Python workers over admitted files.

``EXTRACTORS`` is the registry; an extractor takes ``(text, path)`` and returns a ``Found``. ``facts`` runs
them over a tree and splits the rows into fact tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.extract.java import extract_java
from callweave.extract.rows import Found
from callweave.extract.ruby import extract_ruby
from callweave.extract.schema import extract_graphql, extract_mapper, extract_proto
from callweave.extract.script import extract_script

EXTRACTORS: dict[str, Callable[[str, str], Found]] = {"java": extract_java, "ruby": extract_ruby, "typescript": extract_script, "tsx": extract_script, "javascript": extract_script}
EXTRACTORS |= {"graphql": extract_graphql, "proto": extract_proto, "xml": extract_mapper}

#: A batch ends with the file that brings it to so many rows: one batch a file takes several times as long as the file's extraction.
BATCH = 4096
_LISTS = ("params", "modifiers", "annotations", "supertypes", "arg_types", "str_args")
COLUMNS = {
    "symbols": ["seq", "name", "fqn", "kind", "container_fqn", "type_name", "type_args", "signature", "arity", "params", "start_line", "end_line", "start_byte", "end_byte", "modifiers", "annotations", "supertypes"],
    "refs": ["seq", "from_seq", "name", "receiver", "arity", "arg_types", "str_args", "receiver_seq", "line", "kind"],
    "locals": ["seq", "scope_seq", "name", "type_name", "type_args", "owner_seq", "line", "init_kind", "init_path"],
    "imports": ["seq", "fqn", "simple", "is_wildcard", "is_static", "kind", "orig"],
}
_INTS = {"seq", "from_seq", "receiver_seq", "scope_seq", "owner_seq", "arity", "line", "start_line", "end_line", "start_byte", "end_byte", "is_wildcard", "is_static"}


def _type(column: str) -> pa.DataType:
    return pa.list_(pa.string()) if column in _LISTS else pa.int32() if column in _INTS else pa.string()


_ALL = list(dict.fromkeys(c for columns in COLUMNS.values() for c in columns))


def _ddl(column: str) -> str:
    return f"{column} " + ("array<string>" if column in _LISTS else "int" if column in _INTS else "string")


def _batch(rows: list[tuple[str, str, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[2].get(c) for r in rows], _type(c)) for c in _ALL]], ["path", "record", *_ALL])


def raw_facts(files: DataFrame) -> DataFrame:
    """``path, record`` and every fact column, one row a fact, from admitted files of known languages (``path, lang, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, dict]] = []
        for b in batches:
            for path, lang, text in zip(*b.columns, strict=True):
                try:
                    found, kind = EXTRACTORS[lang.as_py()](text.as_py(), path.as_py()), None
                except Exception as e:  # one file that an extractor can't read (nested too deep, say) doesn't end the job
                    found, kind = Found(), f"unparsable: {type(e).__name__}"
                rows.append((path.as_py(), "file", {"fqn": found.package, "kind": kind}))
                rows += [(path.as_py(), name, row) for name in COLUMNS for row in getattr(found, name)]
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return files.where(F.col("lang").isin(*EXTRACTORS)).select("path", "lang", "text").mapInArrow(run, "path string, record string, " + ", ".join(map(_ddl, _ALL)))


def unparsable(raw: DataFrame) -> DataFrame:
    """``path, reason`` of the files that their extractor couldn't read; they have no facts but the file's own."""
    return raw.where("record = 'file' and kind is not null").select("path", F.col("kind").alias("reason"))


def facts(files: DataFrame, raw: DataFrame, repo_id: str = "") -> dict[str, DataFrame]:
    """Fact tables with ids that repository, path, kind and place give, so that every run and every worker agrees on them.

    An id is 44 bits of a hash of the file and kind before the place in it, so ids of one file ascend as it is read.

    ``raw`` should be a stored table: it is read once for each fact table.
    """
    place = lambda record: F.call_function("shiftleft", F.call_function("shiftright", F.xxhash64(F.lit(repo_id), F.col("path"), F.lit(record)), F.lit(20)), F.lit(20))
    ref = lambda record, c: place(record) + F.col(c)
    file_id = F.xxhash64(F.lit(repo_id), F.lit("file"), F.col("path"))
    base = {"file_id": file_id}
    out = {}
    for record, columns in COLUMNS.items():
        cols = {**base, "id": ref(record, "seq")}
        cols |= {c: F.col(c) for c in columns if not c.endswith("seq")}
        for c, (name, to) in {"from_seq": ("from_symbol_id", "symbols"), "receiver_seq": ("receiver_ref_id", "refs"), "scope_seq": ("scope_symbol_id", "symbols"), "owner_seq": ("owner_ref_id", "refs")}.items():
            if c in columns:
                cols[name] = ref(to, c)
        out[record] = raw.where(F.col("record") == record).select(*[v.alias(k) for k, v in cols.items()])
    packages = raw.where("record = 'file'").select("path", F.col("fqn").alias("pkg"))
    out["files"] = files.join(packages, "path", "left").select(file_id.alias("id"), "path", "lang", "hash", "pkg", "lines", F.lit(0).alias("external"), F.lit(None).cast("string").alias("owner"))
    return out
