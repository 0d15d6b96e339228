"""Schemas of the fact tables, and their version.

One row of ``repo_id`` stands for one repository. Array columns hold nullable strings; flags are 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1


KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


TABLES = {
    "files": _schema("repo_id string, id bigint, path string, lang string, hash string, pkg string, lines int, indexed_at bigint, external int, owner string"),
    "symbols": _schema("repo_id string, id bigint, file_id bigint, name string, fqn string, kind string, container_fqn string, type_name string, type_args string, signature string, arity int, params array<string>, start_line int, end_line int, start_byte int, end_byte int, modifiers array<string>, annotations array<string>, supertypes array<string>"),
    "types": _schema("repo_id string, fqn string, symbol_id bigint, kind string, supertypes array<string>"),
    "imports": _schema("repo_id string, id bigint, file_id bigint, fqn string, simple string, is_wildcard int, is_static int, orig string, kind string"),
    "locals": _schema("repo_id string, id bigint, file_id bigint, scope_symbol_id bigint, name string, type_name string, type_args string, owner_ref_id bigint, line int, init_kind string, init_path string"),
    "refs": _schema("repo_id string, id bigint, file_id bigint, from_symbol_id bigint, name string, receiver string, arity int, arg_types array<string>, str_args array<string>, receiver_ref_id bigint, line int, kind string"),
    "edges": _schema("repo_id string, from_symbol_id bigint, to_symbol_id bigint, kind string, confidence double, via string, line int"),
    "unresolved": _schema("repo_id string, ref_id bigint, reason string, external int, owner string"),
    "bindings": _schema("repo_id string, id bigint, file_id bigint, symbol_id bigint, plugin string, role string, key string, line int, detail string"),
    "meta": _schema("repo_id string, key string, value string"),
}
