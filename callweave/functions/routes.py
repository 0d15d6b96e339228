"""Keys that two sides of a framework share: HTTP routes, queues, topics, endpoints, tables. Native expressions; null refuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.names import _str


def _placeholder(c: Column) -> Column:
    """A configuration key rather than a value."""
    return c.rlike(r"^\$\{.*\}$") | F.contains(c, F.lit("#{"))


#: A parameter in any spelling: ``{id}``, ``${id}``, ``<id>``, ``:id``.
PARAMETER = r"\$?\{[^}]*\}|<[^>]*>|:[A-Za-z_]\w*"


def normal_path(raw: Column | str) -> Column:
    """One spelling of a route: no host, query or fragment; every parameter and number is ``{}``."""
    given = F.trim(_str(raw))
    after = F.regexp_extract(given, "(?i)^https?://(.*)$", 1)
    local = F.when(given.rlike("(?i)^https?://"), F.substring(after, F.locate("/", F.concat(after, F.lit("/"))), F.lit(1 << 30))).otherwise(given)
    shown = F.regexp_replace(F.regexp_extract(local, "^([^?#]*)", 1), PARAMETER, "{}")
    segments = F.transform(F.filter(F.split(shown, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("^[0-9]+$"), "{}").otherwise(x))
    refused = (given == "") | given.rlike(r"\s") | _placeholder(given)
    return F.when(~refused, F.concat(F.lit("/"), F.array_join(segments, "/")))


def join_paths(prefix: Column, path: Column) -> Column:
    both = F.concat(F.regexp_replace(prefix, "/$", ""), F.lit("/"), F.regexp_replace(path, "^/", ""))
    return F.when(prefix.isNull() | (prefix == ""), path).when(path.isNull() | path.isin("", "/"), prefix).otherwise(both)


def route_key(verb: Column, path: Column) -> Column:
    return F.concat(verb, F.lit(" "), normal_path(path))


def endpoint_uri(uri: Column | str) -> Column:
    """An endpoint without options, its scheme in lower case."""
    clean = F.trim(F.substring_index(_str(uri), "?", 1))
    return F.when(F.contains(clean, F.lit(":")), F.concat(F.lower(F.substring_index(clean, ":", 1)), F.regexp_replace(clean, "^[^:]*", "")))


def queue_name(c: Column | str) -> Column:
    """A queue, or the last part of its URL."""
    t = F.trim(_str(c))
    last = F.element_at(F.filter(F.split(t, "/"), lambda x: x != ""), -1)
    return F.when((t == "") | t.rlike(r"\s"), None).when(t.rlike("^https?://"), last).when(_placeholder(t), None).otherwise(t)


def topic_name(c: Column | str) -> Column:
    """A topic; patterns name none."""
    t = F.trim(_str(c))
    return F.when((t != "") & ~t.rlike(r"\s") & ~_placeholder(t) & ~t.rlike(r"[*?]|^/.*/$"), t)


def event_type(c: Column | str) -> Column:
    """An event's simple class name; names too common to join on are refused."""
    simple = F.element_at(F.split(F.regexp_replace(F.trim(_str(c)), "<.*>$", ""), r"\."), -1)
    return F.when(simple.rlike(r"^[A-Z][\w$]*$") & (F.length(simple) >= 3) & ~simple.isin("Object", "String", "Event", "Exception", "Throwable"), simple)


def _pair(a: Column, b: Column, between: str) -> Column:
    word = r"^[A-Za-z_]\w*$"
    return F.when(a.rlike(word) & b.rlike(word), F.concat(a, F.lit(between), b))


def schema_coordinate(type_name: Column, field: Column) -> Column:
    return _pair(type_name, field, ".")


def rpc_coordinate(service: Column, method: Column) -> Column:
    return _pair(service, method, "/")


def service_of_base(base: Column, imports: Column) -> Column:
    """The service whose generated base class this is; a bare name needs the import that says so."""
    name = F.trim(base)
    qualified = F.regexp_extract(name, r"^([A-Za-z_]\w*)Grpc\.\1ImplBase$", 1)
    bare = F.regexp_extract(name, r"^([A-Za-z_]\w*)ImplBase$", 1)
    known = F.exists(imports, lambda x: x.endswith(F.concat(F.lit("."), bare, F.lit("Grpc."), bare, F.lit("ImplBase"))))
    return F.when(qualified != "", qualified).when((bare != "") & known, bare)


#: A word of SQL, quoted and qualified parts included, or a mark.
SQL_TOKEN = r"((?:[\w$]+|\.|\"[^\"]*\"|'[^']*'|`[^`]*`)+|\S)"
#: What stands before the name of a table that a statement changes, or reads or writes.
CHANGES = r"(CREATE|ALTER|DROP) TABLE( IF( NOT)? EXISTS)?$|INSERT INTO$|INDEX \S+ ON$"
USES = r"(^| )(FROM|JOIN)$|INSERT INTO$"


def _tables(sql: Column, before: str) -> Column:
    """The names that follow ``before``, or stand between UPDATE and SET; unqualified, unquoted, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), "--[^\n]*", " ")
    words = F.regexp_extract_all(bare, F.lit(SQL_TOKEN), F.lit(1))
    placed = F.transform(
        words,
        lambda w, i: F.struct(
            w.alias("word"),
            F.upper(F.array_join(F.slice(words, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))), " ")).alias("before"),
            F.upper(F.coalesce(F.get(words, i + 1), F.lit(""))).alias("after"),
        ),
    )
    named = lambda x: x["word"].rlike(r"^[\w\"'`]") & ~F.upper(x["word"]).isin("IF", "NOT", "EXISTS")
    updated = lambda x: x["before"].rlike("(^| )UPDATE$") & (x["after"] == "SET")
    found = F.filter(placed, lambda x: named(x) & (x["before"].rlike(before) | updated(x)))
    last = lambda x: F.element_at(F.split(F.translate(x["word"], "\"'`", ""), r"\."), -1)
    return F.array_distinct(F.transform(found, lambda x: F.lower(last(x))))


def tables_touched(sql: Column) -> Column:
    """Tables that a migration's statements change."""
    return _tables(sql, CHANGES)


def tables_referenced(sql: Column) -> Column:
    """Tables that a query reads or writes."""
    return _tables(sql, USES)


#: A string, a dotted name or a mark of an annotation's arguments.
ARGUMENT_TOKEN = r'("(?:[^"\\]|\\.)*"|[\w.]+|\S)'
_ENTRIES = "array<struct<name: string, value: string, quoted: boolean>>"


def _arguments(raw: Column) -> Column:
    """Every string and name in an annotation's arguments with the attribute that it is given to, empty for positional ones: one pass over the tokens."""
    tokens = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(ARGUMENT_TOKEN), F.lit(1))
    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit("").alias("last"), F.expr(f"cast(array() as {_ENTRIES})").alias("seen"))

    def step(s: Column, token: Column) -> Column:
        string = F.startswith(token, F.lit('"'))
        entry = F.struct(s["name"].alias("name"), F.when(string, F.substring(token, F.lit(2), F.length(token) - 2)).otherwise(token).alias("value"), string.alias("quoted"))
        ends = (token == ",") & (s["depth"] == 0)
        return F.struct(
            F.when(token == "=", s["last"]).when(ends, "").otherwise(s["name"]).alias("name"),
            (s["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)).alias("depth"),
            token.alias("last"),
            F.when(string | token.rlike("^[A-Za-z_]"), F.concat(s["seen"], F.array(entry))).otherwise(s["seen"]).alias("seen"),
        )

    return F.aggregate(tokens, start, step, lambda s: s["seen"])


def attribute_strings(raw: Column, names: list[str]) -> Column:
    """The strings that an annotation gives to the first written one of ``names``, or its positional ones."""
    seen = _arguments(raw)
    given = lambda name: F.transform(F.filter(seen, lambda x: (x["name"] == name) & x["quoted"]), lambda x: x["value"])
    return F.coalesce(*[F.when(F.size(given(n)) > 0, given(n)) for n in names], given(""))


def attribute_identifiers(raw: Column, name: str) -> Column:
    """The identifiers given to an attribute: ``method = RequestMethod.POST`` gives both words."""
    given = F.filter(_arguments(raw), lambda x: (x["name"] == name) & ~x["quoted"])
    return F.flatten(F.transform(given, lambda x: F.split(x["value"], r"\.")))
