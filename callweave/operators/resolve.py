"""Java and Ruby call resolution as joins: names to types, receivers to types, calls to members, and a reason for each call without an edge.

Every rule is a set of candidates with a priority; the first that holds wins (``min_by``). A rule may block: an explicit import
of a foreign type ends the search with no type. Calls on calls and locals typed by calls are resolved in passes, each over
all calls still open, until a pass adds nothing, and every pass is written to the shared folder.

Of overloads that take the number of arguments the one whose parameters' types the arguments have wins, the first declared
of several (``scored``). Outcomes: each call is linked, left for a library (``external``), or missed; names that several types'
methods have are reported, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.names import classify, owner_package
from callweave.functions.predicates import accepts_arity
from callweave.operators.relations import first_written, types_view
from callweave.plans.scratch import Scratch, merged

METHODS = ["method", "constructor"]
#: Types of ``java.lang`` that sources commonly name; no import says whose they are.
IMPLICIT = ["String", "Object", "Integer", "Long", "Double", "Float", "Boolean", "Character", "Byte", "Short", "Number", "Math", "System", "Thread", "Runnable", "Iterable", "Comparable", "Exception", "RuntimeException", "IllegalArgumentException", "IllegalStateException", "StringBuilder", "Class", "Enum", "Record", "Override"]


def preorder(types: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """``fqn, ancestor, path`` of ``types(fqn)`` under ``parents(fqn, parent, at)``: sorted by ``path``, a type's ancestors stand in depth-first preorder.

    A path is the ordinals of the supertypes that lead to an ancestor; the least of all paths is kept. A pair whose path falls is
    sent on again, so an ancestor met first over a short path takes a lesser long one later. A label is never less than that of the
    ancestor it came over, so rounds end on cycles too. Each round joins only the labels that fell with the declarations.
    """
    up = parents.select(F.col("fqn").alias("ancestor"), "parent", "at")
    now = fell = scratch.save(types.select("fqn", F.col("fqn").alias("ancestor"), F.array().cast("array<int>").alias("path")))
    while not fell.isEmpty():
        sent = fell.join(up, "ancestor").where("parent <> fqn").groupBy("fqn", F.col("parent").alias("ancestor")).agg(F.min(F.array_append("path", F.col("at"))).alias("new"))
        after = scratch.save(now.join(sent, ["fqn", "ancestor"], "full").select("fqn", "ancestor", F.least("path", "new").alias("path"), F.expr("new is not null and (path is null or new < path)").alias("fell")))
        fell, now = after.where("fell").drop("fell"), after.drop("fell")
    return now


class Java:
    """The tables of one project and what is known of them; ``resolved`` gives edges and unresolved calls."""

    def __init__(self, files: DataFrame, symbols: DataFrame, imports: DataFrame, locals_: DataFrame, refs: DataFrame) -> None:
        self.scratch = Scratch(files.sparkSession, merge=True)
        self.files, self.symbols, self.imports, self.locals, self.refs = map(merged, (files, symbols, imports, locals_, refs))
        save = self.scratch.save
        self.types = save(types_view(symbols))
        self.own_files = files.where("external = 0").select(F.col("id").alias("file_id"))
        library = files.where("external = 1").select(F.col("id").alias("file_id"), "owner")
        self.library_types = save(symbols.where("container_fqn is null or kind in ('class', 'interface')").join(library, "file_id").groupBy(F.col("fqn").alias("type")).agg(F.min("owner").alias("owner")))
        self.library_files = library.withColumnRenamed("file_id", "member_file")
        self.simple = save(self._simple())
        self.parents = self._parents()
        self.chain = self._chain()
        self.members = save(symbols.where(F.col("kind").isin(*METHODS)).select(F.col("container_fqn").alias("ancestor"), F.col("name").alias("member"), F.col("id").alias("target"), F.col("kind").alias("member_kind"), F.col("arity").alias("member_arity"), "params", F.col("type_name").alias("returns"), F.col("file_id").alias("member_file")))
        self.arguments = save(self._arguments())

    def _arguments(self) -> DataFrame:
        """``id, got``: the argument types of calls that overloads may take: of literals, and of locals as declared; null where unknown."""
        several = self.members.groupBy("ancestor", "member", "member_arity").agg(F.count("*").alias("n")).where("n > 1").select(F.col("member").alias("name")).distinct()
        called = self.refs.where("size(arg_types) > 0 and kind in ('call', 'new')").select("id", "from_symbol_id", "name", "kind", "arg_types")
        wanted = called.where("kind = 'new' or name = '<init>'").unionByName(called.where("kind = 'call' and name <> '<init>'").join(several, "name", "left_semi"))
        each = wanted.select("id", "from_symbol_id", F.posexplode("arg_types").alias("at", "token"))
        declared = self.locals.where("type_name is not null").groupBy(F.col("scope_symbol_id").alias("from_symbol_id"), F.col("name").alias("token")).agg(F.min_by("type_name", "id").alias("declared"))
        typed = each.join(declared, ["from_symbol_id", "token"], "left").select("id", "at", F.when(F.col("token").startswith("!"), F.substring("token", 2, 1 << 30)).otherwise(F.col("declared")).alias("type"))
        return typed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]).alias("got"))  # one entry an argument

    @staticmethod
    def score() -> Column:
        """How well ``params`` fit the arguments ``got``: two for each type that is the same, one for the same simple name."""
        bare = lambda x: F.trim(F.regexp_replace(x, r"<.*$|\[\s*\]", ""))
        last = lambda x: F.element_at(F.split(x, r"\."), -1)
        points = lambda want, got: F.coalesce(F.when(bare(want) == bare(got), 2).when(last(bare(want)) == last(bare(got)), 1), F.lit(0))
        none = F.array().cast("array<string>")
        return F.aggregate(F.zip_with(F.coalesce("params", none), F.coalesce("got", none), points), F.lit(0), lambda s, x: s + x)

    # Names to types

    def _simple(self) -> DataFrame:
        """``name, fqn`` of the project's types whose simple name no other has."""
        return self.types.select("fqn").join(self.library_types.select(F.col("type").alias("fqn")), "fqn", "left_anti").groupBy(F.element_at(F.split("fqn", r"\."), -1).alias("name")).agg(F.count("*").alias("n"), F.min("fqn").alias("fqn")).where("n = 1").select("name", "fqn")

    def named(self, wanted: DataFrame) -> DataFrame:
        """``key, type``: the project's type that ``name`` means at ``file_id`` within ``container``; absent where there is none."""
        asked = self.scratch.save(wanted.where("name is not null").select("key", "file_id", "container", "name").distinct())  # every rule reads it
        own = self.types.select("fqn")
        head = F.substring_index("name", ".", 1)
        tail = F.when(F.contains("name", F.lit(".")), F.regexp_replace("name", r"^[^.]*", "")).otherwise("")
        scopes = asked.where("container is not null").select("*", F.split("container", r"\.").alias("parts"))
        nested = scopes.select("key", "name", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"), "parts").select("key", F.concat(F.array_join(F.slice("parts", 1, F.col("k")), "."), F.lit("."), "name").alias("fqn"), (F.lit(200) - F.col("k")).alias("priority")).join(own, "fqn")
        said = asked.select("key", "file_id", head.alias("simple"), tail.alias("tail")).join(self.imports.where("is_wildcard = 0 and is_static = 0").select("file_id", "simple", F.col("fqn").alias("imported")), ["file_id", "simple"])
        explicit = said.select("key", F.concat("imported", "tail").alias("fqn"), F.lit(300).alias("priority")).join(own.withColumn("known", F.lit(True)), "fqn", "left").select("key", F.when(F.col("known"), F.col("fqn")).alias("fqn"), "priority")
        package = asked.join(self.files.select(F.col("id").alias("file_id"), "pkg"), "file_id").select("key", F.concat_ws(".", "pkg", "name").alias("fqn"), F.lit(400).alias("priority")).join(own, "fqn")
        wild = asked.join(self.imports.where("is_wildcard = 1 and is_static = 0").select("file_id", F.col("fqn").alias("imported")), "file_id").select("key", F.concat_ws(".", "imported", "name").alias("fqn"), F.lit(500).alias("priority")).join(own, "fqn")
        implicit = asked.where(F.col("name").isin(*IMPLICIT)).select("key", F.lit(None).cast("string").alias("fqn"), F.lit(600).alias("priority"))
        lang = asked.withColumn("fqn", F.concat(F.lit("java.lang."), "name")).join(own, "fqn").select("key", "fqn", F.lit(590).alias("priority"))
        unique = asked.where(F.length("name") > 1).join(self.simple, "name").select("key", "fqn", F.lit(700).alias("priority"))
        exact = asked.join(own.withColumnRenamed("fqn", "name"), "name").select("key", F.col("name").alias("fqn"), F.lit(100).alias("priority"))
        every = exact
        for rule in (nested, explicit, package, wild, lang, implicit, unique):
            every = every.unionByName(rule.select("key", "fqn", F.col("priority").cast("int").alias("priority")))
        return every.groupBy("key").agg(F.min(F.struct("priority", "fqn"))["fqn"].alias("type")).where("type is not null")

    def _parents(self) -> DataFrame:
        """``fqn, parent, at``: declared supertypes that are the project's own, in order."""
        said = self.symbols.where("size(supertypes) > 0").select("file_id", "container_fqn", F.col("fqn").alias("child"), F.posexplode("supertypes").alias("at", "name"))
        keyed = said.withColumn("key", F.xxhash64("child", "file_id", "name"))
        met = keyed.join(self.named(keyed.select("key", "file_id", F.col("container_fqn").alias("container"), "name")), "key")
        return self.scratch.save(met.where("type <> child").groupBy(F.col("child").alias("fqn"), F.col("type").alias("parent")).agg(F.min("at").alias("at")))

    def _chain(self) -> DataFrame:
        """``fqn, ancestor, path``: each type, then its supertypes in depth-first preorder, as declared (not Java's most specific)."""
        return preorder(self.types.select("fqn"), self.parents, self.scratch)

    # Calls to members

    def found(self, calls: DataFrame) -> DataFrame:
        """``id`` to the member that ``name`` means on ``type`` with ``arity`` arguments: nearest in the chain, then of the best fitting types, then the first declared."""
        met = calls.join(self.chain.withColumnRenamed("fqn", "type"), "type").join(self.members.withColumnRenamed("member", "name"), ["ancestor", "name"])
        fits = met.where(accepts_arity(F.col("params"), F.col("member_arity"), F.col("arity"))).join(self.arguments, "id", "left").withColumn("behind", -self.score())
        return fits.groupBy("id").agg(F.min(F.struct("path", "behind", "target", "ancestor", "returns", "member_file")).alias("m")).select("id", F.col("m.target").alias("target"), F.col("m.ancestor").alias("declared_by"), F.col("m.returns").alias("returns"), F.col("m.member_file").alias("member_file"))

    def _calls(self) -> DataFrame:
        """Calls with the type that encloses them."""
        inside = self.symbols.select(F.col("id").alias("from_symbol_id"), F.when(F.col("kind").isin("class", "interface", "enum", "record", "annotation"), F.col("fqn")).otherwise(F.col("container_fqn")).alias("container"))
        return self.refs.where("kind <> 'annotation'").join(inside, "from_symbol_id", "left")

    def typed_receivers(self, calls: DataFrame) -> DataFrame:
        """``id, type`` for receivers that are no calls: own type, ``super``, a local, a field, a static type."""
        plain = calls.where("kind = 'call' and receiver_ref_id is null")
        own = plain.where("(receiver is null or receiver = 'this') and container is not null and name <> '<init>'").select("id", F.col("container").alias("type"), F.lit(1).alias("priority"))
        above = plain.where("receiver = 'super'").join(self.parents.where("at = 0").select(F.col("fqn").alias("container"), F.col("parent").alias("type")), "container").select("id", "type", F.lit(1).alias("priority"))
        word = plain.where("receiver is not null and receiver not in ('this', 'super', '(...)', '!String')").withColumn("bare", F.regexp_replace("receiver", r"^this\.", ""))
        known = self.locals.where("type_name is not null").groupBy("scope_symbol_id", "name").agg(F.min("type_name").alias("declared"))
        local = word.where("receiver = bare").join(known.select(F.col("scope_symbol_id").alias("from_symbol_id"), F.col("name").alias("bare"), "declared"), ["from_symbol_id", "bare"]).select("id", "file_id", "container", "declared", F.lit(1).alias("priority"))
        fields = self.symbols.where("kind = 'field' and type_name is not null").select(F.col("container_fqn").alias("ancestor"), F.col("name").alias("bare"), F.col("type_name").alias("declared"), F.col("file_id").alias("field_file"))
        lexical = word.select("id", "bare", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("container", r"\."))), lambda k: F.array_join(F.slice(F.split("container", r"\."), 1, k), "."))).alias("fqn"))
        field = lexical.join(self.chain, "fqn").join(fields, ["ancestor", "bare"]).groupBy("id").agg(F.min(F.struct((-F.length("fqn")).alias("far"), "path", "declared", "field_file", "ancestor")).alias("m"))
        field = field.select("id", F.col("m.field_file").alias("file_id"), F.col("m.ancestor").alias("container"), F.col("m.declared").alias("declared"), F.lit(2).alias("priority"))
        static = word.where("receiver = bare").select("id", "file_id", "container", F.col("bare").alias("declared"), F.lit(3).alias("priority"))
        texts = self.scratch.save(local.unionByName(field).unionByName(static).withColumn("key", F.xxhash64("id", "priority")))
        names = self.named(texts.select("key", "file_id", "container", F.col("declared").alias("name")))
        # A local or field whose type isn't ours blocks the later rules: its name is no static type.
        by_name = texts.join(names, "key", "left").select("id", "type", "priority")
        every = by_name.unionByName(own).unionByName(above)
        return every.groupBy("id").agg(F.min(F.struct("priority", "type"))["type"].alias("type")).where("type is not null")

    def resolved(self) -> tuple[DataFrame, DataFrame]:
        """``edges`` and ``unresolved``."""
        save = self.scratch.save
        calls = save(self._calls())
        made = calls.where("kind = 'new'").withColumn("key", F.col("id"))
        new_types = save(made.join(self.named(made.select("key", "file_id", "container", "name")), "key").select("id", "from_symbol_id", "line", "arity", "type"))
        receivers = typed = save(self.typed_receivers(calls))
        open_ = calls.where("kind = 'call' and name <> '<init>'").select("id", "file_id", "container", "name", "arity", "from_symbol_id", "receiver", "receiver_ref_id")
        targets = save(self.found(self._with_outer(open_.join(receivers, "id"))))
        while True:
            more = self._next(open_, receivers, targets, new_types)
            if more.isEmpty():
                break
            receivers = save(receivers.unionByName(more))
            targets = save(self.found(self._with_outer(open_.join(receivers, "id"))))
        # What a library's type answers is the library's, and so is what is called on its results.
        answered = targets.join(self.library_files, "member_file").select("id", "owner").unionByName(new_types.join(self.library_types, "type").select("id", "owner"))
        answered = self._called_on(calls, save(answered))
        own = lambda rows: merged(rows.join(answered.select("id"), "id", "left_anti"))
        calls_left = own(calls)
        by_name = save(self._by_name(calls_left, own(targets), typed))
        edges = self._edges(calls_left, own(new_types), own(targets), by_name)
        unresolved = self._unresolved(calls_left, own(new_types), receivers, own(targets), by_name)
        proven = answered.select(F.col("id").alias("ref_id"), F.concat(F.lit("external:"), "owner").alias("reason"), F.lit(1).alias("external"), "owner")
        return edges, unresolved.unionByName(proven)

    def _called_on(self, calls: DataFrame, answered: DataFrame) -> DataFrame:
        """``answered`` with the open calls on its results, link after link."""
        links = self.scratch.save(calls.where("receiver_ref_id is not null and kind = 'call'").select("id", "receiver_ref_id"))
        every = frontier = answered
        while not frontier.isEmpty():
            frontier = self.scratch.save(links.join(frontier.select(F.col("id").alias("receiver_ref_id"), "owner"), "receiver_ref_id").select("id", "owner").join(every.select("id"), "id", "left_anti"))
            every = every.unionByName(frontier)
        return self.scratch.save(every)

    @staticmethod
    def _with_outer(calls: DataFrame) -> DataFrame:
        return calls.select("id", "name", "arity", "type")

    def _next(self, open_: DataFrame, receivers: DataFrame, targets: DataFrame, new_types: DataFrame) -> DataFrame:
        """Receivers that earlier passes' results type: calls on calls, and locals that a call typed."""
        returned = targets.where("returns is not null").select(F.col("id").alias("ref"), F.col("member_file").alias("file_id"), F.col("declared_by").alias("container"), F.col("returns").alias("name"), F.col("id").alias("key"))
        results = returned.join(self.named(returned.select("key", "file_id", "container", "name")), "key").select("ref", "type").unionByName(new_types.select(F.col("id").alias("ref"), "type"))
        on_calls = open_.join(results.withColumnRenamed("ref", "receiver_ref_id"), "receiver_ref_id").select("id", "type")
        by_call = self.locals.where("owner_ref_id is not null and type_name is null").select(F.col("scope_symbol_id").alias("from_symbol_id"), F.col("name").alias("receiver"), F.col("owner_ref_id").alias("ref")).join(results, "ref")
        on_locals = open_.where("receiver_ref_id is null").join(by_call, ["from_symbol_id", "receiver"]).groupBy("id").agg(F.min("type").alias("type"))
        return self.scratch.save(on_calls.unionByName(on_locals).join(receivers.select("id"), "id", "left_anti").dropDuplicates(["id"]))

    def _edges(self, calls: DataFrame, new_types: DataFrame, targets: DataFrame, by_name: DataFrame) -> DataFrame:
        def edge(rows: DataFrame, kind, confidence: float, via: str, seq: int) -> DataFrame:
            return rows.select("from_symbol_id", "to_symbol_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(via).alias("via"), "line", F.lit(seq).alias("seq"))

        at = calls.select("id", "from_symbol_id", "line", "name", "arity", "container").where("from_symbol_id is not null")
        types = self.types.select(F.col("fqn").alias("type"), F.col("symbol_id").alias("to_symbol_id"), F.col("kind").alias("type_kind"))
        declared = self.symbols.select(F.col("fqn"), F.col("id").alias("from_symbol_id"), F.col("start_line").alias("line"), F.col("kind").alias("own_kind")).where(F.col("own_kind").isin("class", "interface", "enum", "record")).join(self.parents, "fqn").join(types.withColumnRenamed("type", "parent"), "parent")
        inherits = edge(declared, F.when((F.col("type_kind") == "interface") & (F.col("own_kind") != "interface"), "implements").otherwise("extends"), 1.0, "declaration", 0)
        made = new_types.where("from_symbol_id is not null").join(types, "type")
        instantiates = edge(made, "instantiates", 1.0, "direct", 1)
        constructors = self.members.where("member_kind = 'constructor'").select(F.col("ancestor").alias("type"), F.col("target"), "params", "member_arity")
        built = new_types.where("from_symbol_id is not null").join(constructors, "type").where(accepts_arity(F.col("params"), F.col("member_arity"), F.col("arity"))).join(self.arguments, "id", "left").groupBy("id", "from_symbol_id", "line").agg(F.min(F.struct(-self.score(), "target"))["target"].alias("to_symbol_id"))
        parents = at.where("name = '<init>'").join(self.parents.where("at = 0").withColumnRenamed("fqn", "container"), "container").join(constructors.withColumnRenamed("type", "parent"), "parent").where(accepts_arity(F.col("params"), F.col("member_arity"), F.col("arity"))).join(self.arguments, "id", "left").groupBy("id", "from_symbol_id", "line").agg(F.min(F.struct(-self.score(), "target"))["target"].alias("to_symbol_id"))
        hit = at.join(targets, "id")
        direct = edge(hit.withColumnRenamed("target", "to_symbol_id"), "calls", 1.0, "direct", 3)
        below = self.parents.select(F.col("parent").alias("declared_by"), F.col("fqn").alias("ancestor"))
        impl = hit.select("id", "from_symbol_id", "line", "name", "arity", "declared_by").join(below, "declared_by").join(self.members.where("member_kind = 'method'").withColumnRenamed("member", "name"), ["ancestor", "name"]).where(accepts_arity(F.col("params"), F.col("member_arity"), F.col("arity")))
        fan = edge(impl.withColumnRenamed("target", "to_symbol_id"), "calls", 0.9, "interface->impl", 4)
        unique = edge(by_name.where("n = 1").withColumnRenamed("target", "to_symbol_id"), "calls", 0.5, "unique-name", 5)
        ends = merged(self.symbols.join(self.own_files, "file_id", "left_semi").select("id"))
        every = inherits.unionByName(instantiates).unionByName(edge(built, "calls", 1.0, "constructor", 2)).unionByName(edge(parents, "calls", 1.0, "constructor", 2)).unionByName(direct).unionByName(fan).unionByName(unique)
        for end in ("from_symbol_id", "to_symbol_id"):  # no edge leads into or out of a library
            every = every.join(ends.withColumnRenamed("id", end), end, "left_semi")
        every = every.select("from_symbol_id", "to_symbol_id", "kind", "confidence", "via", "line", "seq")
        return self.scratch.save(first_written(every, ["from_symbol_id", "to_symbol_id", "kind", "line"], "seq").drop("seq"))

    def _by_name(self, calls: DataFrame, targets: DataFrame, typed: DataFrame) -> DataFrame:
        """Calls on receivers of unknown type, with how many methods have their name (those that take the arguments, if any do)."""
        rest = calls.where("kind = 'call' and name <> '<init>' and receiver is not null and receiver not in ('this', 'super', '!String', '(...)') and receiver_ref_id is null and from_symbol_id is not null").join(targets.select("id"), "id", "left_anti")
        rest = rest.join(typed.select("id"), "id", "left_anti").join(self._foreign(rest).select("id"), "id", "left_anti")
        pool = rest.join(merged(self.members.where("member_kind = 'method'").withColumnRenamed("member", "name").join(self.own_files.withColumnRenamed("file_id", "member_file"), "member_file", "left_semi")), "name")
        fits = accepts_arity(F.col("params"), F.col("member_arity"), F.col("arity"))
        counts = pool.groupBy("id", "from_symbol_id", "line").agg(F.count(F.when(fits, 1)).alias("fit"), F.count("*").alias("every"), F.min(F.when(fits, F.col("target"))).alias("best"), F.min("target").alias("any"))
        return counts.select("id", "from_symbol_id", "line", F.when(F.col("fit") > 0, F.col("fit")).otherwise(F.col("every")).alias("n"), F.coalesce("best", "any").alias("target"))

    def _foreign(self, calls: DataFrame) -> DataFrame:
        """``id, owner``: calls whose receiver's declared type, or whose ``new`` type, an import gives to a library."""
        known = self.locals.where("type_name is not null").groupBy("scope_symbol_id", "name").agg(F.min("type_name").alias("declared"))
        local = calls.join(known.select(F.col("scope_symbol_id").alias("from_symbol_id"), F.col("name").alias("receiver"), "declared"), ["from_symbol_id", "receiver"]).select("id", "file_id", "declared")
        fields = self.symbols.where("kind = 'field'").select(F.col("container_fqn").alias("container"), F.col("name").alias("receiver"), F.col("type_name").alias("declared"))
        field = calls.join(fields, ["container", "receiver"]).select("id", "file_id", "declared")
        static = calls.where("receiver is not null").select("id", "file_id", F.substring_index("receiver", ".", 1).alias("declared"))
        made = calls.where("kind = 'new'").select("id", "file_id", F.substring_index("name", ".", 1).alias("declared"))
        own = self.types.select(F.col("fqn").alias("imported"))
        foreign = self.imports.where("is_wildcard = 0 and is_static = 0").select("file_id", F.col("simple").alias("declared"), F.col("fqn").alias("imported")).join(own, "imported", "left_anti")
        foreign = merged(foreign)
        every = local.unionByName(field).unionByName(static).unionByName(made)
        implicit = every.where(F.col("declared").isin(*IMPLICIT)).select("id", F.lit("java.lang").alias("owner"))
        return merged(every.join(foreign, ["file_id", "declared"]).select("id", owner_package("imported").alias("owner")).unionByName(implicit).groupBy("id").agg(F.min("owner").alias("owner")))

    def _unresolved(self, calls: DataFrame, new_types: DataFrame, receivers: DataFrame, targets: DataFrame, named: DataFrame) -> DataFrame:
        """One row for each call without an edge: the reason, whether it left the project, and whose it is."""
        linked = targets.select("id").unionByName(new_types.select("id")).unionByName(named.where("n = 1").select("id"))
        supers = calls.where("name = '<init>'").join(self.parents.select(F.col("fqn").alias("container")), "container", "left_semi").select("id")
        rest = calls.join(linked.unionByName(supers).distinct(), "id", "left_anti")
        declared = merged(self.symbols.join(self.own_files, "file_id", "left_semi").where(F.col("kind").isin("method", "constructor", "class", "interface", "enum", "record")).select("name").distinct().withColumn("declared", F.lit(True)))
        statics = self.imports.where("is_static = 1 and is_wildcard = 0").select("file_id", F.col("simple").alias("name"), owner_package("fqn").alias("static_owner")).dropDuplicates(["file_id", "name"])
        known = rest.join(declared, "name", "left").join(self._foreign(rest), "id", "left").join(statics, ["file_id", "name"], "left").join(receivers, "id", "left").join(named.select("id", "n"), "id", "left")
        bare = F.col("receiver").isNull()
        reason = (
            F.when(F.col("from_symbol_id").isNull(), "no-enclosing-symbol")
            .when(F.col("owner").isNotNull(), F.concat(F.lit("external:"), "owner"))
            .when(bare & F.col("static_owner").isNotNull(), F.concat(F.lit("external:"), "static_owner"))
            .when(F.col("name") == "<init>", "external")
            .when(F.col("declared").isNull(), "external:not-in-project")
            .when(F.col("kind") == "new", "unknown-type")
            .when(F.col("receiver_ref_id").isNotNull() & F.col("type").isNull() | (F.col("receiver") == "(...)"), "complex-receiver-chain")
            .when(bare, "external:not-reachable-from-scope")
            .when(F.col("type").isNotNull(), F.concat(F.lit("no-such-method-on:"), "type"))
            .when(F.col("n") > 1, "ambiguous-name")
            .otherwise("unknown-method")
        )
        out = known.select(F.col("id").alias("ref_id"), reason.alias("reason"), F.when(reason.startswith("external"), 1).otherwise(0).alias("external"), F.when(reason.startswith("external:"), F.coalesce("owner", F.when(bare, F.col("static_owner")))).alias("owner"))
        return self.scratch.save(out)


#: Methods of Ruby's ``Kernel`` and ``Object`` that calls commonly name.
KERNEL = ["puts", "print", "p", "pp", "raise", "require", "require_relative", "loop", "lambda", "proc", "rand", "sleep", "format", "sprintf", "printf", "catch", "throw", "freeze", "frozen?", "tap", "then", "send", "public_send", "respond_to?", "instance_variable_get", "instance_variable_set", "is_a?", "kind_of?", "nil?", "dup", "clone", "to_s", "inspect", "hash", "object_id", "block_given?", "binding", "exit", "abort", "at_exit", "warn", "gets", "open", "system", "Array", "Integer", "Float", "String"]


class Ruby:
    """Ruby call resolution: constants and typed receivers first, then conventions, then names declared once. Bare words that name nothing are dropped, not missed.

    What types a receiver gives an edge its reason and confidence (``CONFIDENCE``). A receiver that nothing types has the model it is
    named after, if that is a record and has the member. A type without the member, all of whose ancestors are known, answers by its
    ``method_missing``; with an ancestor from outside the call is that one's. Bare calls reach a method outside all classes last.
    """

    #: Confidence by what types the receiver, and the ancestors that make a record.
    CONFIDENCE = {"direct": 1.0, "rails-association": 0.8, "self-chain": 0.7, "name-convention": 0.5}
    RECORDS = "ApplicationRecord|ActiveRecord::Base|ActiveModel"

    def __init__(self, symbols: DataFrame, locals_: DataFrame, refs: DataFrame) -> None:
        self.scratch = Scratch(symbols.sparkSession, merge=True)
        self.symbols, self.locals, self.refs = map(merged, (symbols, locals_, refs))
        save = self.scratch.save
        self.types = save(types_view(symbols))
        said = self.types.select("fqn", F.posexplode("supertypes").alias("at", "name")).withColumn("key", F.xxhash64("fqn", "name"))
        self.parents = save(said.join(self.named(said.select("key", F.col("fqn").alias("container"), "name")), "key").where("type <> fqn").groupBy("fqn", F.col("type").alias("parent")).agg(F.min("at").alias("at")))
        self.chain = Java._chain(self)
        self.members = save(symbols.where(F.col("kind").isin("method", "class_method")).select(F.col("container_fqn").alias("ancestor"), F.col("name"), F.col("id").alias("target"), F.col("kind").alias("member_kind"), F.col("type_name").alias("returns"), F.array_contains("modifiers", "generated").alias("generated")))
        supers = self.types.select(F.col("fqn").alias("ancestor"), "supertypes")
        named_so = F.exists("supertypes", lambda x: x.rlike(self.RECORDS)) | (F.col("ancestor") == "ApplicationRecord")
        self.records = save(self.chain.join(supers, "ancestor").where(named_so).select(F.col("fqn").alias("type")).distinct())
        unknown = said.join(self.named(said.select("key", F.col("fqn").alias("container"), "name")), "key", "left_anti").select(F.col("fqn").alias("ancestor"), "at", "name")
        self.outside = save(self.chain.join(unknown, "ancestor").groupBy(F.col("fqn").alias("type")).agg(F.min(F.struct("path", "at", "name"))["name"].alias("outside")))

    def named(self, wanted: DataFrame) -> DataFrame:
        """``key, type``: a constant as its scopes see it, the innermost first, then a simple name declared once."""
        asked = wanted.where("name is not null").select("key", "container", F.regexp_replace("name", "^::", "").alias("name")).distinct()
        own = self.types.select("fqn")
        unique = own.groupBy(F.element_at(F.split("fqn", "::"), -1).alias("name")).agg(F.count("*").alias("n"), F.min("fqn").alias("fqn")).where("n = 1").select("name", "fqn")
        parts = F.split("container", "::")
        scoped = asked.where("container is not null").select("key", "name", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k")).select("key", F.concat(F.array_join(F.slice("parts", 1, F.col("k")), "::"), F.lit("::"), "name").alias("fqn"), (F.lit(200) - F.col("k")).alias("priority")).join(own, "fqn")
        exact = asked.join(own.withColumnRenamed("fqn", "name"), "name").select("key", F.col("name").alias("fqn"), F.lit(300).alias("priority"))
        simple = asked.join(unique, "name").select("key", "fqn", F.lit(400).alias("priority"))
        every = exact.unionByName(scoped.select("key", "fqn", "priority")).unionByName(simple)
        return merged(every.groupBy("key").agg(F.min(F.struct("priority", "fqn"))["fqn"].alias("type")))

    def found(self, calls: DataFrame) -> DataFrame:
        """``id`` to the nearest member of the type; methods of the wanted kind before others."""
        met = calls.join(self.chain.withColumnRenamed("fqn", "type"), "type").join(self.members, ["ancestor", "name"])
        rank = F.when(F.col("member_kind") == F.col("wanted"), 0).otherwise(1)
        return merged(met.groupBy("id").agg(F.min(F.struct(rank.alias("r"), "path", "target", "returns", "ancestor")).alias("m")).select("id", "m.target", "m.returns", F.col("m.ancestor").alias("declared_by")))

    def resolved(self) -> tuple[DataFrame, DataFrame]:
        save = self.scratch.save
        inside = self.symbols.select(F.col("id").alias("from_symbol_id"), F.when(F.col("kind").isin("class", "module"), F.col("fqn")).otherwise(F.col("container_fqn")).alias("container"), F.col("kind").alias("own_kind"))
        calls = save(self.refs.where("kind <> 'annotation'").join(inside, "from_symbol_id", "left"))
        made = calls.where("kind = 'new'").withColumn("key", F.col("id"))
        new_types = save(made.join(self.named(made.select("key", "container", "name")), "key").select("id", "from_symbol_id", "line", "type"))
        open_ = calls.where("kind <> 'new'").select("id", "from_symbol_id", "container", "own_kind", "name", "receiver", "receiver_ref_id")
        own = open_.where("(receiver is null or receiver = 'self') and receiver_ref_id is null and container is not null").select("id", "name", F.col("container").alias("type"), F.when(F.col("own_kind").isin("class_method", "class", "module"), "class_method").otherwise("method").alias("wanted"), F.lit("self-chain").alias("via"))
        const = open_.where(F.col("receiver").rlike("^[A-Z]")).withColumn("key", F.col("id"))
        const = const.join(self.named(const.select("key", "container", F.col("receiver").alias("name"))), "key").select("id", "name", "type", F.lit("class_method").alias("wanted"), F.lit("direct").alias("via"))
        receivers = save(own.unionByName(const).unionByName(self._by_local(open_)).groupBy("id", "name").agg(F.min(F.struct("type", "wanted", "via")).alias("m")).select("id", "name", "m.*"))
        targets = save(self.found(receivers))
        readers = self.chain.join(self.members.where("returns is not null and member_kind = 'method'").withColumnRenamed("name", "receiver"), "ancestor").groupBy(F.col("fqn").alias("container"), "receiver").agg(F.min(F.struct("path", "target", "ancestor", "returns", "generated")).alias("m")).select("container", "receiver", "m.ancestor", "m.returns", "m.generated")
        by_reader = open_.where("receiver_ref_id is null and receiver is not null").join(readers, ["container", "receiver"]).withColumn("key", F.col("id"))
        by_reader = save(by_reader.join(self.named(by_reader.select("key", F.col("ancestor").alias("container"), F.col("returns").alias("name"))), "key").select("id", "name", "type", F.when(F.col("generated"), "rails-association").otherwise("direct").alias("via")))
        by_name = self._by_convention(open_)
        built = new_types.select(F.col("id").alias("receiver_ref_id"), "type", F.lit("direct").alias("via"))
        while True:
            returned = targets.where("returns is not null").select(F.col("id").alias("key"), F.col("declared_by").alias("container"), F.col("returns").alias("name"))
            results = returned.join(self.named(returned), "key").select(F.col("key").alias("receiver_ref_id"), "type", F.lit("rails-association").alias("via")).unionByName(built)
            fresh = lambda rows: save(rows.withColumn("wanted", F.lit("method")).join(receivers.select("id"), "id", "left_anti").dropDuplicates(["id"]))  # noqa: E731, B023
            more = fresh(open_.join(results, "receiver_ref_id").select("id", "name", "type", "via").unionByName(by_reader))
            if more.isEmpty():  # conventions come after all that is declared, and may type more calls in turn
                more = fresh(by_name)
                if more.isEmpty():
                    break
            receivers = save(receivers.unionByName(more))
            targets = save(self.found(receivers))
        return self._outcome(calls, new_types, receivers, targets)

    def _by_local(self, open_: DataFrame) -> DataFrame:
        """Receivers that are locals of the scope, or instance variables that any method of the class types; a finder's result counts if its class is a record."""
        scopes = self.symbols.select(F.col("id").alias("scope_symbol_id"), F.when(F.col("kind").isin("class", "module"), F.col("fqn")).otherwise(F.col("container_fqn")).alias("container"))
        typed = self.locals.where("type_name is not null").select("scope_symbol_id", "name", F.struct("id", F.col("type_name").alias("declared"), F.coalesce("init_kind", F.lit("")).alias("kind")).alias("l"))
        calls = open_.where("receiver is not null")
        local = calls.join(typed.groupBy(F.col("scope_symbol_id").alias("from_symbol_id"), F.col("name").alias("receiver")).agg(F.min("l").alias("l")), ["from_symbol_id", "receiver"]).withColumn("far", F.lit(0))
        held = typed.where("name like '@%'").join(scopes, "scope_symbol_id").groupBy("container", F.col("name").alias("receiver")).agg(F.min("l").alias("l"))
        both = local.unionByName(calls.join(held, ["container", "receiver"]).withColumn("far", F.lit(1)))
        rows = both.groupBy("id", "name", "container").agg(F.min_by("l", "far").alias("l")).select(F.col("id").alias("key"), "id", "name", "container", "l.declared", "l.kind")
        met = rows.join(self.named(rows.select("key", "container", F.col("declared").alias("name"))), "key")
        finder = F.col("kind") == "finder"
        met = met.join(self.records.withColumn("record", F.lit(True)), "type", "left").where(~finder | F.coalesce("record", F.lit(False)))
        return met.select("id", "name", "type", F.lit("method").alias("wanted"), F.when(finder, "rails-association").otherwise("direct").alias("via"))

    def _by_convention(self, open_: DataFrame) -> DataFrame:
        """Receivers named after a record of the project that has the called member."""
        words = open_.where("own_kind is not null").select(F.col("id").alias("receiver_ref_id"), F.col("name").alias("word")).join(self.refs.where("kind = 'ident_call' and receiver is null").select(F.col("id").alias("receiver_ref_id")), "receiver_ref_id", "left_semi")
        said = open_.join(words, "receiver_ref_id", "left").select(F.col("id").alias("key"), "id", "name", "container", F.coalesce("word", F.when(F.col("receiver_ref_id").isNull(), F.col("receiver"))).alias("word"))
        said = said.where(F.col("word").rlike("^@?[a-z_][A-Za-z0-9_]*$") & (F.col("word") != "self"))
        met = said.join(self.named(said.select("key", "container", classify(F.regexp_replace("word", "^@", "")).alias("name"))), "key").join(self.records, "type", "left_semi")
        met = met.select("id", "name", "type", F.lit("method").alias("wanted"))
        has = self.found(met).join(self.members.where("member_kind = 'method'").select("target"), "target", "left_semi").select("id")
        return self.scratch.save(met.join(has, "id", "left_semi").withColumn("via", F.lit("name-convention")))

    def _outcome(self, calls: DataFrame, new_types: DataFrame, receivers: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = calls.where("from_symbol_id is not null").select("id", "from_symbol_id", "line", "name", "kind", "receiver", "receiver_ref_id")
        columns = lambda rows, kind, confidence, via, seq: rows.select("from_symbol_id", "to_symbol_id", F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(via).alias("via"), "line", F.lit(seq).alias("seq"))
        types = self.types.select(F.col("fqn").alias("type"), F.col("symbol_id").alias("to_symbol_id"), "kind")
        declared = self.parents.join(types.select(F.col("type").alias("fqn"), F.col("to_symbol_id").alias("from_symbol_id")), "fqn").join(types.withColumnRenamed("type", "parent"), "parent").withColumn("line", F.lit(0))
        inherits = columns(declared.where("kind = 'class'"), "extends", 1.0, "declaration", 0).unionByName(columns(declared.where("kind = 'module'"), "includes", 1.0, "declaration", 0))
        made = columns(new_types.where("from_symbol_id is not null").join(types.drop("kind"), "type"), "instantiates", 1.0, "direct", 1)
        built = self.found(new_types.withColumn("name", F.lit("initialize")).withColumn("wanted", F.lit("method")).select("id", "name", "type", "wanted"))
        constructed = columns(at.join(built, "id").withColumnRenamed("target", "to_symbol_id"), "calls", 1.0, "constructor", 2)
        hit = at.join(targets, "id")
        sure = F.lit(None).cast("double")
        for via, confidence in self.CONFIDENCE.items():
            sure = F.when(F.col("via") == via, confidence).otherwise(sure)
        direct = hit.join(receivers.select("id", "via"), "id").select("from_symbol_id", F.col("target").alias("to_symbol_id"), F.lit("calls").alias("kind"), sure.alias("confidence"), "via", "line", F.lit(3).alias("seq"))
        open_at = at.join(targets.select("id"), "id", "left_anti").join(new_types.select("id"), "id", "left_anti")
        outer = self.members.where("ancestor = 'Object' and member_kind = 'method'").groupBy("name").agg(F.min("target").alias("target"))
        bare = self.scratch.save(open_at.where("receiver is null and kind <> 'new'").join(outer, "name"))
        top = columns(bare.withColumnRenamed("target", "to_symbol_id"), "calls", self.CONFIDENCE["self-chain"], "self-chain", 5)
        absent = open_at.where("kind = 'call'").join(bare.select("id"), "id", "left_anti").join(receivers.select("id", "type"), "id")
        inherited = self.scratch.save(absent.join(self.outside, "type").select("id", "outside"))
        caught = absent.join(self.outside, "type", "left_anti").withColumn("name", F.lit("method_missing")).withColumn("wanted", F.lit("method"))
        caught = self.scratch.save(caught.join(merged(self.found(caught.select("id", "name", "type", "wanted")).join(self.members.where("member_kind = 'method'").select("target"), "target", "left_semi")), "id"))
        missing = columns(caught.withColumnRenamed("target", "to_symbol_id"), "calls", 0.4, "method-missing", 6)
        below = merged(self.parents.join(self.types.where("kind = 'module'").select(F.col("fqn").alias("parent")), "parent").select(F.col("parent").alias("declared_by"), F.col("fqn").alias("ancestor")))
        fan = columns(hit.select("from_symbol_id", "line", "name", "declared_by").join(below, "declared_by").join(self.members.select("ancestor", "name", F.col("target").alias("to_symbol_id")), ["ancestor", "name"]), "calls", 0.7, "module->includer", 4)
        rest = at.where("kind = 'call' and receiver is not null and receiver <> 'self'").join(targets.select("id"), "id", "left_anti").join(receivers.select("id"), "id", "left_anti").where(~F.col("receiver").rlike("^[A-Z]"))
        pool = rest.join(self.members.where("member_kind = 'method'").select("name", "target"), "name").groupBy("id", "from_symbol_id", "line").agg(F.count("*").alias("n"), F.min("target").alias("to_symbol_id"))
        pool = merged(pool)
        unique = columns(pool.where("n = 1"), "calls", 0.4, "unique-name", 7)
        every = inherits.unionByName(made).unionByName(constructed).unionByName(direct).unionByName(fan).unionByName(top).unionByName(missing).unionByName(unique)
        edges = self.scratch.save(first_written(every, ["from_symbol_id", "to_symbol_id", "kind", "line"], "seq").drop("seq"))
        linked = targets.select("id").unionByName(new_types.select("id")).unionByName(pool.where("n = 1").select("id")).unionByName(bare.select("id")).unionByName(caught.select("id")).distinct()
        open_ = calls.where("kind <> 'ident_call'").join(linked, "id", "left_anti")  # a bare word without a declaration is a variable
        names = self.symbols.select("name").distinct().withColumn("declared", F.lit(True))
        known = open_.join(names, "name", "left").join(receivers.select("id", "type"), "id", "left").join(pool.select("id", "n"), "id", "left").join(inherited, "id", "left")
        constant = F.coalesce(F.regexp_extract("receiver", "^([A-Z]\\w*)", 1), F.when(F.col("kind") == "new", F.col("name")), F.lit(""))
        reason = (
            F.when(F.col("from_symbol_id").isNull(), "no-enclosing-symbol")
            .when((constant != "") & F.col("type").isNull(), F.concat(F.lit("external:"), constant))
            .when(F.col("outside").isNotNull(), F.concat(F.lit("external:"), "outside"))
            .when(F.col("name").isin(*KERNEL), "external:Kernel")
            .when(F.col("declared").isNull(), "external:not-in-project")
            .when(F.col("receiver") == "(...)", "complex-receiver-chain")
            .when(F.col("receiver").isNull(), "external:not-reachable-from-scope")
            .when(F.col("n") > 1, "ambiguous-name")
            .otherwise("unknown-method")
        )
        unresolved = known.select(F.col("id").alias("ref_id"), reason.alias("reason"), reason.startswith("external").cast("int").alias("external"), F.when(reason.startswith("external:") & ~reason.isin("external:not-in-project", "external:not-reachable-from-scope"), F.regexp_replace(reason, "^external:", "")).alias("owner"))
        return edges, self.scratch.save(unresolved)
