"""TypeScript and JavaScript call resolution as joins: imports to modules, names through exports, receivers to declared types.

A name means what its file declares or imports, never a like-named type elsewhere. Receivers are followed along their path
(``this.repo.store``) field by field; calls on calls and locals typed by calls are resolved in passes, until a pass adds nothing.
An awaited local takes the argument of a ``Promise``. Only a method whose name is declared once is linked without a type (0.5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.relations import first_written, types_view
from callweave.operators.resolve import Java
from callweave.plans.scratch import Scratch
from callweave.sources.modules import exported, resolved_modules

TYPES = ["class", "interface", "enum"]


class Script:
    def __init__(self, files: DataFrame, symbols: DataFrame, imports: DataFrame, locals_: DataFrame, refs: DataFrame, alias: DataFrame, packages: DataFrame) -> None:
        self.scratch = Scratch(files.sparkSession)
        self.files, self.symbols, self.imports, self.locals, self.refs = files, symbols, imports, locals_, refs
        save = self.scratch.save
        self.types = save(types_view(symbols))
        self.modules = files.select(F.col("id").alias("file_id"), F.col("pkg").alias("from_module"))
        said = imports.where("kind in ('import', 'reexport')").join(self.modules, "file_id").select("file_id", "from_module", F.col("fqn").alias("specifier"), "simple", "orig", "kind")
        found = resolved_modules(said, self.modules.withColumnRenamed("from_module", "module"), alias, packages)
        self.said = save(said.join(found, ["from_module", "specifier"], "left"))
        self.names = self._names()
        self.parents = Java._parents(self)
        self.chain = Java._chain(self)
        self.members = save(symbols.where("kind in ('method', 'constructor')").select(F.col("container_fqn").alias("ancestor"), "name", F.col("id").alias("target"), F.col("type_name").alias("returns"), F.col("type_args").alias("returns_of"), F.col("file_id").alias("member_file")))

    # Names

    def _names(self) -> DataFrame:
        """``file_id, simple, fqn``: what a name means in a file; ``ns.name`` for the members of an imported namespace."""
        top = self.symbols.join(self.modules, "file_id").where("container_fqn = from_module")
        own = top.select("file_id", F.col("name").alias("simple"), "fqn", F.col("from_module").alias("module"), "modifiers")
        marked = own.where(F.array_contains("modifiers", "export"))
        listed = self.imports.where("kind = 'export'").join(self.modules.withColumnRenamed("from_module", "module"), "file_id").select("file_id", "module", F.col("simple").alias("name"), F.col("orig").alias("simple"))
        direct = (
            marked.select("module", F.col("simple").alias("name"), F.col("fqn").alias("origin"))
            .unionByName(marked.where(F.array_contains("modifiers", "default")).select("module", F.lit("default").alias("name"), F.col("fqn").alias("origin")))
            .unionByName(listed.join(own.select("file_id", "simple", "fqn"), ["file_id", "simple"]).select("module", "name", F.col("fqn").alias("origin")))
        )
        taken = self.said.where("kind = 'import' and module is not null").select("file_id", "simple", "orig", F.col("module").alias("from_module"))
        passed = listed.join(taken, ["file_id", "simple"]).select("module", "from_module", "name", "orig")
        again = self.said.where("kind = 'reexport' and module is not null").select(F.col("from_module").alias("module"), F.col("module").alias("from_module"), F.col("simple").alias("name"), "orig")
        given = self.scratch.save(exported(direct, passed.unionByName(again)))
        every = given.select(F.col("module").alias("from_module"), "name", "origin")
        single = taken.join(every.withColumnRenamed("name", "orig"), ["from_module", "orig"]).select("file_id", "simple", F.col("origin").alias("fqn"), F.lit(1).alias("rule"))
        spaces = taken.where("orig = '*'").drop("orig").join(every, "from_module")
        whole = spaces.where("name = 'default'").select("file_id", "simple", F.col("origin").alias("fqn"), F.lit(2).alias("rule"))
        inside = spaces.select("file_id", F.concat_ws(".", "simple", "name").alias("simple"), F.col("origin").alias("fqn"), F.lit(3).alias("rule"))
        rules = own.select("file_id", "simple", "fqn", F.lit(0).alias("rule")).unionByName(single).unionByName(whole).unionByName(inside)
        return self.scratch.save(rules.groupBy("file_id", "simple").agg(F.min(F.struct("rule", "fqn"))["fqn"].alias("fqn")))

    def named(self, wanted: DataFrame) -> DataFrame:
        """``key, type``: the type that ``name`` means at ``file_id``; absent where it is none of the project's."""
        asked = wanted.where("name is not null").select("key", "file_id", F.col("name").alias("simple")).distinct()
        return asked.join(self.names, ["file_id", "simple"]).join(self.types.select("fqn"), "fqn").groupBy("key").agg(F.min("fqn").alias("type"))

    # Receivers

    def _declared(self) -> DataFrame:
        """``from_symbol_id, head``: names that are variables there; ``declared`` is the type of the first that says one."""
        return self.locals.groupBy(F.col("scope_symbol_id").alias("from_symbol_id"), "file_id", F.col("name").alias("head")).agg(F.min_by("type_name", F.when(F.col("type_name").isNotNull(), F.col("id"))).alias("declared"))

    def _paths(self, calls: DataFrame) -> DataFrame:
        """``id, file_id, head, rest``: the first name of a receiver's path and the fields after it."""
        parts = F.split("receiver", r"\.")
        return calls.where("receiver is not null and receiver not in ('(...)', '!String') and receiver_ref_id is null").select("id", "from_symbol_id", "file_id", "container", "receiver", parts[0].alias("head"), F.slice(parts, F.lit(2), F.size(parts)).alias("rest"))

    def _follow(self, rows: DataFrame) -> DataFrame:
        """``id, type`` at the end of ``rest``, field after field, from ``id, type, rest``."""
        fields = self.symbols.where("kind = 'field' or array_contains(modifiers, 'get')").where("type_name is not null").select(F.col("container_fqn").alias("ancestor"), F.col("name").alias("field"), F.col("type_name").alias("declared"), "file_id")
        done, open_ = rows.where("size(rest) = 0").select("id", "type"), self.scratch.save(rows.where("size(rest) > 0"))
        while not open_.isEmpty():  # paths lose a part each time
            met = open_.withColumn("field", F.col("rest")[0]).join(self.chain.withColumnRenamed("fqn", "type"), "type").join(fields, ["ancestor", "field"])
            near = met.groupBy("id", "rest").agg(F.min(F.struct("path", "declared", "file_id")).alias("m")).select("id", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), F.col("m.declared").alias("name"), F.col("m.file_id").alias("file_id")).withColumn("key", F.col("id"))
            rows = self.scratch.save(near.join(self.named(near), "key").select("id", "type", "rest"))
            done, open_ = done.unionByName(rows.where("size(rest) = 0").select("id", "type")), rows.where("size(rest) > 0")
        return done

    def _plain(self, calls: DataFrame) -> DataFrame:
        """``id, type`` for receivers that don't wait for a call's result."""
        paths = self._paths(calls)
        own = paths.where("head = 'this'").select("id", F.col("container").alias("type"), "rest")
        above = paths.where("head = 'super'").join(self.parents.where("at = 0").select(F.col("fqn").alias("container"), F.col("parent").alias("type")), "container").select("id", "type", "rest")
        held = self._declared()
        words = paths.where("head not in ('this', 'super')")
        inner = words.join(held.drop("file_id"), ["from_symbol_id", "head"])
        outer = words.join(inner.select("id"), "id", "left_anti").join(held.where("from_symbol_id is null").drop("from_symbol_id"), ["file_id", "head"])
        local = inner.select("id", "file_id", "declared", "rest").unionByName(outer.select("id", "file_id", "declared", "rest"))
        static = words.join(local.select("id"), "id", "left_anti")
        static = static.select("id", "file_id", F.col("head").alias("declared"), "rest").unionByName(static.where("size(rest) > 0").select("id", "file_id", F.col("receiver").alias("declared"), F.array().cast("array<string>").alias("rest")))
        texts = local.unionByName(static).withColumn("key", F.xxhash64("id", "declared"))
        typed = texts.join(self.named(texts.select("key", "file_id", F.col("declared").alias("name"))), "key").select("id", "type", "rest")
        return self._follow(own.unionByName(above).unionByName(typed)).dropDuplicates(["id"])

    def found(self, calls: DataFrame) -> DataFrame:
        """``id`` to the nearest member named so in the chain of ``type``; numbers of arguments don't matter to the language."""
        met = calls.join(self.chain.withColumnRenamed("fqn", "type"), "type").join(self.members, ["ancestor", "name"])
        return met.groupBy("id").agg(F.min(F.struct("path", "target", "returns", "returns_of", "member_file", "ancestor")).alias("m")).select("id", "m.target", "m.returns", "m.returns_of", "m.member_file", F.col("m.ancestor").alias("declared_by"))

    def _functions(self, calls: DataFrame) -> DataFrame:
        """Bare calls and calls on namespaces to the functions that their names mean; a variable of that name hides them."""
        asked = calls.where("kind = 'call' and name <> '<init>' and receiver_ref_id is null").select("id", "from_symbol_id", "file_id", F.concat_ws(".", "receiver", "name").alias("simple"), F.coalesce("receiver", "name").alias("head"))
        asked = asked.join(self._declared().select("from_symbol_id", "head"), ["from_symbol_id", "head"], "left_anti")
        own = self.symbols.where("kind = 'function'").groupBy("fqn").agg(F.min(F.struct(F.col("id").alias("target"), F.col("type_name").alias("returns"), F.col("type_args").alias("returns_of"), F.col("file_id").alias("member_file"))).alias("m"))
        return asked.join(self.names, ["file_id", "simple"]).join(own, "fqn").select("id", "m.target", "m.returns", "m.returns_of", "m.member_file", F.lit(None).cast("string").alias("declared_by"))

    # Outcomes

    def resolved(self) -> tuple[DataFrame, DataFrame]:
        """``edges`` and ``unresolved``."""
        save = self.scratch.save
        inside = self.symbols.select(F.col("id").alias("from_symbol_id"), F.when(F.col("kind").isin(*TYPES), F.col("fqn")).otherwise(F.col("container_fqn")).alias("container"))
        calls = save(self.refs.join(inside, "from_symbol_id", "left"))
        made = calls.where("kind = 'new'").withColumn("key", F.col("id"))
        new_types = save(made.join(self.named(made), "key").select("id", "from_symbol_id", "line", "type"))
        open_ = calls.where("kind = 'call' and name <> '<init>'")
        functions = save(self._functions(calls))
        receivers = save(self._plain(open_))
        targets = save(functions.unionByName(self.found(open_.join(receivers, "id").join(functions.select("id"), "id", "left_anti").select("id", "name", "type"))))
        while True:
            kept = targets.select(F.col("id").alias("ref"), "member_file", "returns", "returns_of")
            results = self._results(kept.withColumn("name", F.col("returns"))).unionByName(new_types.select(F.col("id").alias("ref"), "type"))
            waited = self._results(kept.withColumn("name", F.when(F.col("returns") == "Promise", F.col("returns_of")).otherwise(F.col("returns"))))
            held = self.locals.where("owner_ref_id is not null and type_name is null").select(F.col("scope_symbol_id").alias("from_symbol_id"), F.col("name").alias("head"), F.col("owner_ref_id").alias("ref"), "init_kind")
            held = held.where("init_kind = 'await'").join(waited, "ref").unionByName(held.where("init_kind <> 'await'").join(results, "ref"))
            late = self._paths(open_.join(receivers.select("id"), "id", "left_anti")).join(held.groupBy("from_symbol_id", "head").agg(F.min("type").alias("type")), ["from_symbol_id", "head"]).select("id", "type", "rest")
            on_calls = open_.join(results.withColumnRenamed("ref", "receiver_ref_id"), "receiver_ref_id").select("id", "type")
            more = save(self._follow(late).unionByName(on_calls).join(receivers.select("id"), "id", "left_anti").dropDuplicates(["id"]))
            if more.isEmpty():
                break
            receivers = save(receivers.unionByName(more))
            targets = save(targets.unionByName(self.found(open_.join(more, "id").join(targets.select("id"), "id", "left_anti").select("id", "name", "type"))))
        # What a library's declaration answers is proven to be the library's, and so is what is called on its results.
        library = self.files.where("external = 1").select(F.col("id").alias("member_file"), "owner")
        answered = save(targets.join(library, "member_file").select("id", "owner").unionByName(new_types.join(self._library_types(), "type").select("id", "owner")))
        own = lambda rows: rows.join(answered.select("id"), "id", "left_anti")
        return self._outcome(calls, own(new_types), receivers, own(targets), answered)

    def _library_types(self) -> DataFrame:
        library = self.files.where("external = 1").select(F.col("id").alias("file_id"), "owner")
        return self.symbols.where(F.col("kind").isin(*TYPES)).join(library, "file_id").groupBy(F.col("fqn").alias("type")).agg(F.min("owner").alias("owner"))

    def _called_on(self, calls: DataFrame, foreign: DataFrame) -> DataFrame:
        """``foreign`` with the open calls on its results, link after link."""
        links = self.scratch.save(calls.where("receiver_ref_id is not null and kind = 'call'").select("id", "receiver_ref_id"))
        every = frontier = self.scratch.save(foreign)
        while not frontier.isEmpty():
            frontier = self.scratch.save(links.join(frontier.select(F.col("id").alias("receiver_ref_id"), "owner"), "receiver_ref_id").select("id", "owner").join(every.select("id"), "id", "left_anti"))
            every = every.unionByName(frontier)
        return every

    def _results(self, returned: DataFrame) -> DataFrame:
        asked = returned.select(F.col("ref").alias("key"), F.col("member_file").alias("file_id"), "name")
        return self.named(asked).withColumnRenamed("key", "ref")

    def _outcome(self, calls: DataFrame, new_types: DataFrame, receivers: DataFrame, targets: DataFrame, answered: DataFrame) -> tuple[DataFrame, DataFrame]:
        columns = lambda rows, kind, confidence, via, seq: rows.select("from_symbol_id", "to_symbol_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(via).alias("via"), "line", F.lit(seq).alias("seq"))
        at = calls.where("from_symbol_id is not null").select("id", "from_symbol_id", "line", "name", "container")
        types = self.types.select(F.col("fqn").alias("type"), F.col("symbol_id").alias("to_symbol_id"), F.col("kind").alias("type_kind"))
        declared = self.symbols.where(F.col("kind").isin(*TYPES)).select("fqn", F.col("id").alias("from_symbol_id"), F.col("start_line").alias("line"), F.col("kind").alias("own_kind")).join(self.parents, "fqn").join(types.withColumnRenamed("type", "parent"), "parent")
        inherits = columns(declared, F.when((F.col("type_kind") == "interface") & (F.col("own_kind") == "class"), "implements").otherwise("extends"), 1.0, "declaration", 0)
        made = columns(new_types.where("from_symbol_id is not null").join(types, "type"), "instantiates", 1.0, "direct", 1)
        above = at.where("name = '<init>'").join(self.parents.where("at = 0").select(F.col("fqn").alias("container"), F.col("parent").alias("type")), "container")
        builds = new_types.select("id", "type").unionByName(above.select("id", "type")).withColumn("name", F.lit("constructor"))
        built = self.scratch.save(self.found(builds))
        constructed = columns(at.join(built, "id").withColumnRenamed("target", "to_symbol_id"), "calls", 1.0, "constructor", 2)
        hit = at.join(targets, "id")
        direct = columns(hit.withColumnRenamed("target", "to_symbol_id"), "calls", 1.0, "direct", 3)
        below = self.parents.select(F.col("parent").alias("declared_by"), F.col("fqn").alias("ancestor"))
        fan = columns(hit.select("from_symbol_id", "line", "name", "declared_by").join(below, "declared_by").join(self.members.select("ancestor", "name", F.col("target").alias("to_symbol_id")), ["ancestor", "name"]), "calls", 0.9, "interface->impl", 4)
        linked = targets.select("id").unionByName(new_types.select("id"))
        by_name = self._foreign(calls).join(answered.select("id"), "id", "left_anti")
        foreign = self.scratch.save(self._called_on(calls, answered.unionByName(by_name)).join(linked, "id", "left_anti"))
        rest = calls.where("kind = 'call' and from_symbol_id is not null and name <> '<init>' and receiver is not null and receiver not in ('this', 'super', '!String')")
        for known in (targets, receivers, foreign):
            rest = rest.join(known.select("id"), "id", "left_anti")
        own_files = self.files.where("external = 0").select(F.col("id").alias("member_file"))
        once = self.members.join(own_files, "member_file", "left_semi").where("name <> 'constructor'").groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("to_symbol_id"))
        pool = self.scratch.save(rest.select("id", "from_symbol_id", "line", "name").join(once, "name"))
        unique = columns(pool.where("n = 1"), "calls", 0.5, "unique-name", 5)
        every = inherits.unionByName(made).unionByName(constructed).unionByName(direct).unionByName(fan).unionByName(unique)
        ends = self.symbols.join(own_files.withColumnRenamed("member_file", "file_id"), "file_id", "left_semi").select("id")
        for end in ("from_symbol_id", "to_symbol_id"):  # no edge leads into or out of a library
            every = every.join(ends.withColumnRenamed("id", end), end, "left_semi")
        edges = self.scratch.save(first_written(every.select("from_symbol_id", "to_symbol_id", "kind", "confidence", "via", "line", "seq"), ["from_symbol_id", "to_symbol_id", "kind", "line"], "seq").drop("seq"))
        linked = targets.select("id").unionByName(new_types.select("id")).unionByName(above.select("id")).unionByName(pool.where("n = 1").select("id")).distinct()
        names = self.symbols.join(own_files.withColumnRenamed("member_file", "file_id"), "file_id", "left_semi").select("name").distinct().withColumn("declared", F.lit(True))
        known = calls.join(linked, "id", "left_anti").join(names, "name", "left").join(receivers, "id", "left").join(pool.select("id", "n"), "id", "left").join(foreign, "id", "left")
        reason = (
            F.when(F.col("from_symbol_id").isNull(), "no-enclosing-symbol")
            .when(F.col("owner").isNotNull(), F.concat(F.lit("external:"), "owner"))
            .when(F.col("name") == "<init>", "external")
            .when(F.col("declared").isNull(), "external:not-in-project")
            .when(F.col("kind") == "new", "unknown-type")
            .when(F.col("receiver").isNull(), "external:not-reachable-from-scope")
            .when(F.col("type").isNotNull(), F.concat(F.lit("no-such-method-on:"), "type"))
            .when(F.col("receiver") == "(...)", "complex-receiver-chain")
            .when(F.col("n") > 1, "ambiguous-name")
            .otherwise("unknown-method")
        )
        return edges, self.scratch.save(known.select(F.col("id").alias("ref_id"), reason.alias("reason"), reason.startswith("external").cast("int").alias("external"), F.when(reason.startswith("external:"), F.col("owner")).alias("owner")))

    def _foreign(self, calls: DataFrame) -> DataFrame:
        """``id, owner``: calls whose name, receiver or receiver's declared type a library's import gives, or whose receiver is an array."""
        word = F.coalesce(F.substring_index("receiver", ".", 1), F.substring_index("name", ".", 1))
        heads = calls.select("id", "from_symbol_id", "file_id", "container", word.alias("head"), F.regexp_extract("receiver", r"^this\.([\w$]+)$", 1).alias("field"))
        fields = self.symbols.where("kind = 'field' and type_name is not null").select(F.col("container_fqn").alias("container"), F.col("name").alias("field"), F.col("type_name").alias("declared")).dropDuplicates(["container", "field"])
        said = (
            heads.select("id", "file_id", F.col("head").alias("declared"))
            .unionByName(heads.join(self._declared().drop("file_id"), ["from_symbol_id", "head"]).select("id", "file_id", "declared"))
            .unionByName(heads.join(fields, ["container", "field"]).select("id", "file_id", "declared"))
            .where("declared is not null")
        )
        owner = F.when(F.col("specifier").startswith("@"), F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
        library = self.said.where("module is null and kind = 'import' and not startswith(specifier, '.')").select("file_id", F.col("simple").alias("declared"), owner.alias("owner"))
        array = said.where(F.col("declared").endswith("[]")).select("id", F.lit("Array").alias("owner"))
        return said.withColumn("declared", F.substring_index("declared", ".", 1)).join(library, ["file_id", "declared"]).select("id", "owner").unionByName(array).groupBy("id").agg(F.min("owner").alias("owner"))
