"""Rails projects: columns of ``db/schema.rb`` as generated attributes, and the routes of ``config/routes.rb``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.names import candidate_models


def schema_columns(texts: DataFrame) -> DataFrame:
    """``table, column``: every column that the schema text declares, the implicit key too unless it is turned off. Native."""
    blocks = texts.select(F.explode(F.expr(r"slice(split(text, '(?m)^\\s*create_table\\s+'), 2, 1000000)")).alias("block"))
    parts = blocks.select(
        F.regexp_extract("block", "^[\"']([^\"']+)", 1).alias("table"),
        F.substring_index("block", "\n", 1).alias("head"),
        F.regexp_extract("block", r"do\s*\|(\w+)\|", 1).alias("var"),
        F.regexp_replace("block", r"(?s)\n  end\b.*$", "").alias("body"),
    ).where("table <> '' and var <> ''")
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^\s*\w+\.\w+\s+[\"'][^\"']+[\"']"))
    said = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\w+)\.", 1).alias("var"), F.regexp_extract(x, r"^\s*\w+\.(\w+)", 1).alias("kind"), F.regexp_extract(x, r"[\"']([^\"']+)[\"']", 1).alias("name")))
    each = parts.select("table", "var", F.explode(said).alias("c")).where("c.var = var and c.kind not in ('index', 'check_constraint')").select("table", F.col("c.name").alias("column"))
    keys = parts.where(~F.col("head").rlike(r"\bid:\s*false\b")).select("table", F.lit("id").alias("column"))
    return each.unionByName(keys).distinct()


def column_attributes(columns: DataFrame, symbols: DataFrame) -> DataFrame:
    """``container_fqn, name, table``: reader, writer and query of every column on the first model that exists for its table."""
    models = symbols.where("kind = 'class'").groupBy(F.element_at(F.split("fqn", "::"), -1).alias("model")).agg(F.min("fqn").alias("container_fqn"))
    tables = columns.select("table").distinct().select("table", F.posexplode(candidate_models("table")).alias("pos", "model"))
    chosen = tables.join(models, "model").groupBy("table").agg(F.min_by("container_fqn", "pos").alias("container_fqn"))
    return columns.join(chosen, "table").select("container_fqn", F.explode(F.array("column", F.concat("column", F.lit("=")), F.concat("column", F.lit("?")))).alias("name"), "table").distinct()


# Routes

#: The actions that a resource declares, with their verbs and path ends.
PLURAL = [("index", "GET", ""), ("create", "POST", ""), ("new", "GET", "/new"), ("show", "GET", "/{}"), ("edit", "GET", "/{}/edit"), ("update", "PUT", "/{}"), ("update", "PATCH", "/{}"), ("destroy", "DELETE", "/{}")]
SINGULAR = [("show", "GET", ""), ("create", "POST", ""), ("new", "GET", "/new"), ("edit", "GET", "/edit"), ("update", "PUT", ""), ("update", "PATCH", ""), ("destroy", "DELETE", "")]

TOKEN = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|%[iIwW]\[[^\]]*\]|\#.*|=>|[A-Za-z_]\w*:(?!:)|:[A-Za-z_]\w*|[A-Za-z_][\w.]*|\S""")
Value = str | list[str]
Route = tuple[str, str, str | None, str | None, int]


@dataclass
class Call:
    """A statement: its word, positional arguments, keyword arguments, and the statements of its block."""

    word: str
    line: int
    arguments: list[Value] = field(default_factory=list)
    named: dict[str, Value] = field(default_factory=dict)
    block: list[Call] = field(default_factory=list)
    opens: bool = False

    def first(self) -> str:
        return self.arguments[0] if self.arguments and isinstance(self.arguments[0], str) else ""

    def text(self, key: str, otherwise: str = "") -> str:
        value = self.named.get(key, otherwise)
        return value if isinstance(value, str) else otherwise

    def several(self, key: str) -> list[str]:
        value = self.named.get(key, [])
        return [value] if isinstance(value, str) else value


def _value(tokens: list[str], i: int) -> tuple[Value | None, int]:
    """The literal at ``i`` and the place after it; None for what is no literal."""
    t = tokens[i]
    if t[0] in "'\"":
        return t[1:-1], i + 1
    if t[0] == ":" and len(t) > 1:
        return t[1:], i + 1
    if t[0] == "%" and len(t) > 1:
        return t[3:-1].split(), i + 1
    if t == "[":
        inside, i = [], i + 1
        while i < len(tokens) and tokens[i] != "]":
            value, i = _value(tokens, i)
            inside += [value] if isinstance(value, str) else []
        return inside, i + 1
    return None, i + 1


def call(text: str, line: int) -> Call | None:
    """The statement on a line, None for an empty one."""
    tokens = [t for t in TOKEN.findall(text) if not t.startswith("#")]
    if not tokens:
        return None
    made, i, key = Call(tokens[0], line), 1, None
    if "do" in tokens:
        tokens, made.opens = tokens[: tokens.index("do")], True
    while i < len(tokens):
        if tokens[i].endswith(":") and len(tokens[i]) > 1:
            key, i = tokens[i][:-1], i + 1
            continue
        value, after = _value(tokens, i)
        if value is not None:
            if key is not None:
                made.named[key] = value
            elif after < len(tokens) and tokens[after] == "=>":  # 'path' => 'target', or :option => value
                target, end = _value(tokens, after + 1) if after + 1 < len(tokens) else (None, after + 1)
                if tokens[i].startswith(":") and made.arguments:
                    made.named[value] = target
                else:
                    made.arguments.append(value)
                    made.named["to"] = target
                after = end
            else:
                made.arguments.append(value)
        key, i = None, after
    return made


def calls(text: str) -> list[Call]:
    """The file's statements as a tree of blocks."""
    path = [Call("", 0)]
    for number, raw in enumerate(text.split("\n"), 1):
        found = call(raw, number)
        if found is None:
            continue
        if found.word == "end":
            del path[max(1, len(path) - 1) :]
            continue
        path[-1].block.append(found)
        if found.opens:
            path.append(found)
    return path[0].block


@dataclass(frozen=True)
class Place:
    """Where a statement stands: path, modules, the resource's controller, and the path that its collection has."""

    path: str = ""
    modules: tuple[str, ...] = ()
    controller: str | None = None
    collection: str = ""

    def under(self, part: str) -> str:
        return f"{self.path}/{part.strip('/')}" if part.strip("/") else self.path

    def named(self, controller: str) -> str:
        camel = ("".join(word[:1].upper() + word[1:] for word in part.split("_")) for part in controller.split("/"))
        return "::".join((*self.modules, *camel))

    def action(self, spec: str) -> tuple[str | None, str | None]:
        """``controller#action``, or an action of the resource."""
        controller, mark, action = spec.partition("#")
        if mark:
            return self.named(controller), action
        return (self.controller, spec) if self.controller and spec else (None, None)


def _namespace(c: Call, at: Place) -> tuple[list[Route], Place]:
    path = at.under(c.text("path", c.first()))
    return [], Place(path, (*at.modules, at.named(c.first()).rpartition("::")[2]), None, path)


def _scope(c: Call, at: Place) -> tuple[list[Route], Place]:
    path, module = at.under(c.text("path", c.first())), c.text("module")
    return [], replace(at, path=path, collection=path, modules=(*at.modules, *Place().named(module).split("::")) if module else at.modules)


def _resource(c: Call, at: Place) -> tuple[list[Route], Place]:
    single = c.word == "resource"
    controller = at.named(c.text("controller", c.first() + ("s" if single else "")))
    path = at.under(c.text("path", c.first()))
    wanted = set(c.several("only")) if "only" in c.named else None
    made = [(verb, path + end, controller, action, c.line) for action, verb, end in (SINGULAR if single else PLURAL) if (wanted is None or action in wanted) and action not in c.several("except")]
    return made, Place(path if single else path + "/{}", at.modules, controller, path)


def _collection(c: Call, at: Place) -> tuple[list[Route], Place]:
    return [], replace(at, path=at.collection)


def _root(c: Call, at: Place) -> tuple[list[Route], Place]:
    return [("GET", at.path or "/", *at.action(c.text("to", c.first())), c.line)], at


def _verb(c: Call, at: Place) -> tuple[list[Route], Place]:
    spec = c.text("to")
    if not spec and c.text("controller") and c.text("action"):
        spec = f"{c.text('controller')}#{c.text('action')}"
    if not spec and re.fullmatch(r"\w+", c.first()):
        spec = c.text("action", c.first())
    base = replace(at, path=at.collection) if c.text("on") == "collection" else at
    verbs = [v.upper().replace("ALL", "ANY") for v in c.several("via")] or ["ANY"] if c.word == "match" else [c.word.upper()]
    return [(verb, base.under(c.first()), *at.action(spec), c.line) for verb in verbs], at


MEANINGS = {"namespace": _namespace, "scope": _scope, "resources": _resource, "resource": _resource, "collection": _collection, "root": _root} | dict.fromkeys(("get", "post", "put", "patch", "delete", "match"), _verb)


def rails_routes(text: str) -> list[Route]:
    """(verb, path, controller, action, line) of every route that the file declares."""
    out: list[Route] = []
    open_ = [(c, Place()) for c in reversed(calls(text))]
    while open_:
        c, at = open_.pop()
        if c.word in MEANINGS and (c.arguments or c.word in ("scope", "collection", "root")):
            made, at = MEANINGS[c.word](c, at)
            out += made
        open_ += [(inner, at) for inner in reversed(c.block)]
    return out


def routes(files: DataFrame) -> DataFrame:
    """``path, verb, route, controller, action, line`` of routing files (``path, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p.as_py(), *r) for p, t in zip(*b.columns, strict=True) for r in rails_routes(t.as_py() or "")]
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "verb", "route", "controller", "action", "line"])

    return files.select("path", "text").mapInArrow(run, "path string, verb string, route string, controller string, action string, line int")
