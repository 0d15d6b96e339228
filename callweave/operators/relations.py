"""Joins between symbols, files, edges, calls and endpoints, all at once for every symbol asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.predicates import TYPE_KINDS, is_generated, is_test_path, language_family, open_reason
from callweave.plans.scratch import merged

SYMBOL_COLUMNS = ["id", "name", "fqn", "kind", "container_fqn", "type_name", "signature", "arity", "start_line", "end_line", "annotations", "modifiers"]
#: How many ways the rows of a key are dealt where a join gives far more rows than it reads.
SALTS = 16
#: Rows of a list that stands for them in such a join, about.
LIST = 1024
MEMBER_KINDS = ["method", "constructor", "class_method", "field"]


def located(symbols: DataFrame, files: DataFrame, own_only: bool = False) -> DataFrame:
    """The standard symbol projection: symbol columns with the file's path and language."""
    where = files.where("external = 0") if own_only else files
    return symbols.join(where.select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "lang"), "file_id").select(*SYMBOL_COLUMNS, "file_id", "file_path", "lang")


def public_shape(symbols: DataFrame) -> DataFrame:
    """The outward JSON of a located symbol; fields without value are left out."""
    shape = F.struct("id", "name", F.coalesce("fqn", "name").alias("fqn"), "kind", F.col("file_path").alias("file"), F.col("start_line").alias("line"), "lang", is_generated(F.col("modifiers")).alias("derived"), is_test_path(F.col("file_path")).alias("isTest"))
    return symbols.select("id", F.to_json(shape).alias("json"))


def first_written(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert-or-ignore: of the rows of a key the one of least ``seq``; nulls in a key are equal."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("__rn = 1").drop("__rn")


def last_written(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert-or-replace."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).where("__rn = 1").drop("__rn")


def grouped_edges(edges: DataFrame, near: str, far: str) -> DataFrame:
    """One row a pair and kind: the strongest edge (the least via in a tie) and the sorted distinct lines."""
    best = F.min(F.struct((-F.col("confidence")).alias("weakness"), "via"))
    return edges.groupBy(F.col(near).alias("of_id"), F.col(far).alias("id"), F.col("kind").alias("edge_kind")).agg(F.max("confidence").alias("confidence"), best["via"].alias("via"), F.array_sort(F.collect_set("line")).alias("lines"))


def callers(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """For every symbol ``of_id`` those with an edge to it. Only columns that the answer shows are read."""
    return grouped_edges(edges, "to_symbol_id", "from_symbol_id").join(located(symbols, files).select("id", "fqn", "kind", "file_path", "lang"), "id")


def callees(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    return grouped_edges(edges, "from_symbol_id", "to_symbol_id").join(located(symbols, files).select("id", "fqn", "kind", "start_line", "file_path", "lang"), "id")


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop is one row."""
    out = edges.select(F.col("from_symbol_id").alias("id"), F.col("to_symbol_id").alias("other"), "kind", "via", "confidence", F.lit("out").alias("way"))
    back = edges.where("from_symbol_id <> to_symbol_id").select(F.col("to_symbol_id").alias("id"), F.col("from_symbol_id").alias("other"), "kind", "via", "confidence", F.lit("in").alias("way"))
    return out.unionByName(back)


def file_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` paths of the project's own files with an edge between them."""
    own = symbols.join(files.where("external = 0").select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")
    a, b = own.select(F.col("id").alias("from_symbol_id"), F.col("path").alias("src")), own.select(F.col("id").alias("to_symbol_id"), F.col("path").alias("dst"))
    return edges.select("from_symbol_id", "to_symbol_id").distinct().join(a, "from_symbol_id").join(b, "to_symbol_id").where("src <> dst").select("src", "dst").distinct()


def met_evenly(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``, for joins that give far more rows than they read.

    The input's bytes say nothing of the output, so a plan that goes by them runs it in a few tasks: here ``many`` is dealt by key and
    salt over as many tasks as shuffles have, and ``few`` repeated for each salt. Neither is broadcast, as then the other would be read by few tasks.
    """
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = many.withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int")).repartition(n, *keys, "salt")
    return merged(salted).join(merged(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))), [*keys, "salt"]).drop("salt")


def met_by_lists(many: DataFrame, few: DataFrame, keys: list[str], apart: str | None = None, where: Column | None = None) -> DataFrame:
    """``met_evenly``, with the rows of ``few`` gathered in lists of bounded length by key (and ``apart``) before the join and given one by one after it.

    A row of the answer then costs a step along a list, not one of the join; ``where`` is asked of a row and a list. Rows without a key or ``apart`` meet none.
    """
    by = [*keys, apart] if apart else keys
    values = [c for c in few.columns if c not in by]
    parts = few.groupBy(*by).agg(F.ceil(F.count("*") / LIST).alias("parts"))
    lists = few.join(parts, by).groupBy(*by, F.pmod(F.xxhash64(*values), "parts").alias("part")).agg(F.collect_list(F.struct(*values)).alias("l")).select(*by, *[F.col(f"l.{c}").alias(c) for c in values])
    met = met_evenly(many, lists, keys)
    met = met if where is None else met.where(where)
    rest = [c for c in met.columns if c not in values]
    each = met.select(*rest, *values[1:], F.posexplode(values[0]).alias("at", values[0]))
    return each.select(*rest, values[0], *[F.col(c)[F.col("at")].alias(c) for c in values[1:]])


def members(symbols: DataFrame) -> DataFrame:
    """``type_id, member_id``: what each type contains."""
    types, inside = containers(symbols)
    named = lambda rows, c: rows.select(F.col("id").alias(c), F.col("container").alias("container_fqn"))
    return met_evenly(named(inside, "member_id"), named(types, "type_id"), ["container_fqn"]).select("type_id", "member_id")


def containers(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, container`` of types, by their own name, and of members, by their container's: ``members`` before the two meet."""
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS) & F.col("fqn").isNotNull()).select("id", F.col("fqn").alias("container"))
    return types, symbols.where(F.col("kind").isin(*MEMBER_KINDS) & F.col("container_fqn").isNotNull()).select("id", F.col("container_fqn").alias("container"))


def subtypes(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    below = symbols.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("subtype"))
    return edges.where(F.col("kind").isin("implements", "extends")).join(below, "from_symbol_id").select(F.col("to_symbol_id").alias("type_id"), F.col("from_symbol_id").alias("subtype_id"), "subtype", "kind").distinct()


def open_calls(unresolved: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Calls of the project's own files that have no edge and might be anyone's of that name."""
    own = files.where("external = 0").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"), "lang")
    left = unresolved.where((F.col("external") == 0) & open_reason(F.col("reason"))).select("ref_id", "reason")
    calls = refs.where("kind <> 'annotation'").select(F.col("id").alias("ref_id"), "file_id", "from_symbol_id", "name", "receiver", F.col("arity").alias("call_arity"), F.col("kind").alias("call_kind"), "line")
    return left.join(calls, "ref_id").join(own, "file_id").withColumn("is_test", is_test_path(F.col("file_path"))).withColumn("family", language_family(F.col("lang")))


def unlinked_calls(unresolved: DataFrame, refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Open calls with the symbol that they stand in, if any."""
    inside = symbols.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("from_fqn"))
    return open_calls(unresolved, refs, files).join(inside, "from_symbol_id", "left").select("ref_id", "name", "receiver", "call_arity", "call_kind", "line", "reason", "file_path", "lang", "from_symbol_id", "from_fqn", "is_test")


def innermost(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each ``(id, file_id, line)`` the symbol whose span holds the line most closely, else the file's first class, module or function.

    An equi-join on the file with a range residual; the closest is a map-side aggregate, not a sort of all holders.
    """
    spans = symbols.select("file_id", F.col("id").alias("symbol_id"), "start_line", "end_line")
    held = points.join(spans, "file_id").where("line between start_line and end_line")
    best = held.groupBy("id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "symbol_id"))["symbol_id"].alias("inner"))
    anchors = symbols.where(F.col("kind").isin("class", "module", "function")).groupBy("file_id").agg(F.min(F.struct("start_line", F.col("id").alias("symbol_id")))["symbol_id"].alias("anchor"))
    return points.join(best, "id", "left").join(anchors, "file_id", "left").select("id", "file_id", "line", F.coalesce("inner", "anchor").alias("symbol_id"), F.col("inner").isNotNull().alias("contained"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each ``path`` the longest ``prefix`` that it is or lies under: every ancestor directory is looked up by equality, so no range join is needed."""
    parts = F.split("path", "/")
    ancestors = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    met = paths.select("path", ancestors.alias("prefix")).join(prefixes.select("prefix"), "prefix")
    best = met.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.select("path").distinct().join(best, "path", "left")


def chain_depths(refs: DataFrame, hops: int = 4) -> DataFrame:
    """How many calls stand before each in its chain, at most ``hops``: bounded self-joins on the receiver pointer."""
    pointers = refs.select(F.col("id").alias("at"), F.col("receiver_ref_id").alias("next"))
    now = refs.select("id", F.col("receiver_ref_id").alias("at"), F.lit(0).alias("depth"))
    for _ in range(hops):
        met = now.join(pointers, "at", "left")
        now = met.select("id", F.when(F.col("at").isNotNull(), F.col("next")).alias("at"), (F.col("depth") + F.col("at").isNotNull().cast("int")).alias("depth"))
    return now.select("id", "depth")


def endpoint_pairs(bindings: DataFrame, edge_kind: Column, confidence: Column) -> DataFrame:
    """Every consumer of a key with every provider of it, within a plugin, never with itself.

    Both sides are reduced to distinct endpoints before they meet. A pair that shares several keys is given at the least of them, so
    pairs are distinct without a shuffle of them all. An end carries its keys less than the present one, as hashes to 64 bits too:
    only where these meet are the keys looked at.
    """
    ends = bindings.where("symbol_id is not null and key is not null")

    def by_key(rows: DataFrame, less: str, *cols: str) -> DataFrame:
        each = rows.groupBy("plugin", *cols).agg(F.collect_set("key").alias("keys")).select("plugin", *cols, "keys", F.explode("keys").alias("key")).withColumn(less, F.expr("filter(keys, x -> x < key)"))
        return each.select("plugin", "key", *cols, F.expr(f"aggregate({less}, 0L, (b, x) -> b | shiftleft(1L, cast(pmod(xxhash64(x), 64) as int)))").alias(f"{less}_bits"), less)

    makers = by_key(ends.where("role = 'provider'").select("plugin", "key", F.col("symbol_id").alias("to_symbol_id")), "made", "to_symbol_id")
    users = by_key(ends.where("role = 'consumer'").select("plugin", "key", F.col("symbol_id").alias("from_symbol_id"), "line"), "used", "from_symbol_id", "line").withColumn("via", F.concat(F.lit("binding:"), "plugin"))
    met = met_by_lists(users, makers, ["plugin", "key"]).where("from_symbol_id <> to_symbol_id and ((used_bits & made_bits) = 0 or not arrays_overlap(used, made))")
    return met.select("from_symbol_id", "to_symbol_id", edge_kind.alias("kind"), confidence.alias("confidence"), "via", "line")


def cross_repo_pairs(bindings: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Endpoints of one plugin and key with opposite roles in different repositories: consumer to provider; with ``near(symbol_id)``, pairs with either end among these."""
    ends = bindings.where("symbol_id is not null").select("repo_id", "plugin", "key", "role", "symbol_id").distinct()
    makers = ends.where("role = 'provider'").select("plugin", "key", F.col("repo_id").alias("to_repo"), F.col("symbol_id").alias("to_symbol_id"))
    users = ends.where("role = 'consumer'").select("plugin", "key", F.col("repo_id").alias("from_repo"), F.col("symbol_id").alias("from_symbol_id"))
    if near is None:
        met = met_by_lists(users, makers, ["plugin", "key"], "to_repo", F.col("from_repo") != F.col("to_repo"))
    else:  # few endpoints are near, so they are taken before any pair is made; pairs with both ends near come of the first half
        by = lambda rows, c, how: rows.join(near.select(F.col("symbol_id").alias(c)), c, how)
        columns = ["plugin", "key", "from_repo", "from_symbol_id", "to_repo", "to_symbol_id"]
        one = by(users, "from_symbol_id", "left_semi").join(makers, ["plugin", "key"]).select(columns)
        two = by(users, "from_symbol_id", "left_anti").join(by(makers, "to_symbol_id", "left_semi"), ["plugin", "key"]).select(columns)
        met = one.unionByName(two)
    return met.where("from_repo <> to_repo").select("from_repo", "from_symbol_id", "to_repo", "to_symbol_id", "plugin", "key", F.lit(0.85).alias("confidence"))


def supertype_links(symbols: DataFrame, types: DataFrame) -> DataFrame:
    """Declared supertypes that are the project's own types."""
    said = symbols.select(F.col("id").alias("from_symbol_id"), F.explode("supertypes").alias("fqn"))
    return said.join(types.select("fqn", F.col("symbol_id").alias("to_symbol_id")), "fqn").select("from_symbol_id", "to_symbol_id", "fqn").distinct()


def types_view(symbols: DataFrame) -> DataFrame:
    """One row a type name: its first symbol, that one's kind, and all declarations' supertypes in the order first seen."""
    own = symbols.where(F.col("kind").isin(*TYPE_KINDS) & F.col("fqn").isNotNull())
    first = own.groupBy("fqn").agg(F.min("id").alias("symbol_id"), F.min_by("kind", "id").alias("kind"))
    said = own.select("fqn", "id", F.posexplode("supertypes").alias("pos", "sup")).groupBy("fqn", "sup").agg(F.min(F.struct("id", "pos")).alias("at"))
    lists = said.groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct("at", "sup"))).alias("l")).select("fqn", F.col("l.sup").alias("supertypes"))
    return first.join(lists, "fqn", "left").withColumn("supertypes", F.coalesce("supertypes", F.array().cast("array<string>")))
