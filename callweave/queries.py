"""Registered queries over the star tables, by operator id, each with its SQL restatement in ``callweave.oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.functions import names, predicates, routes
from callweave.operators import cycles, graph, insight, mappers, relations, routing, search, stats, views
from callweave.plans.rendered import Diamonds, Rendered, RenderedRuby, Schemas
from callweave.plans.star import Facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
    QUERIES[make.__name__] = lambda spark, sf_dir: make(Facts(spark, sf_dir))
    return make


def _joined(*columns: str) -> list:
    """Lists as text, for comparison across engines."""
    return [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) for c in columns]


# Joins


@query
def j1_located_symbols(f: Facts) -> DataFrame:
    return relations.located(f.symbols, f.files).select("id", "name", "fqn", "kind", "start_line", "file_path", "lang", *_joined("modifiers"))


@query
def j2_callers(f: Facts) -> DataFrame:
    return relations.callers(f.edges, f.symbols, f.files).select("of_id", "id", "edge_kind", "confidence", "via", *_joined("lines"), "fqn", "file_path")


@query
def j3_callees(f: Facts) -> DataFrame:
    return relations.callees(f.edges, f.symbols, f.files).select("of_id", "id", "edge_kind", "confidence", "via", *_joined("lines"), "fqn", "start_line")


@query
def j4_neighbours(f: Facts) -> DataFrame:
    return relations.neighbours(f.edges).groupBy("id", "other", "kind").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query
def j5_file_edges(f: Facts) -> DataFrame:
    return relations.file_edges(f.edges, f.symbols, f.files)


@query
def j6_unlinked_calls(f: Facts) -> DataFrame:
    return relations.unlinked_calls(f.unresolved, f.refs, f.files, f.symbols)


@query
def j7_route_endpoints(f: Facts) -> DataFrame:
    return routing.endpoints(f.bindings, f.symbols, f.files).select("id", "key", "role", "detail", "line", "file_path", "fqn")


@query
def j8_unreached(f: Facts) -> DataFrame:
    return insight.unreached(f.edges, f.bindings, f.symbols, f.files).select("id", "name", "file_path")


@query
def j9_declared_names(f: Facts) -> DataFrame:
    """Calls whose name some own symbol declares."""
    own = f.symbols.join(f.files.where("external = 0").select(F.col("id").alias("file_id")), "file_id", "left_semi").select("name")
    return f.refs.join(own, "name", "left_semi").select("id", "name", "kind")


@query
def j10_endpoint_pairs(f: Facts) -> DataFrame:
    return relations.endpoint_pairs(f.bindings, F.lit("binds"), F.lit(0.9))


@query
def j11_cross_repo_pairs(f: Facts) -> DataFrame:
    return relations.cross_repo_pairs(f.bindings)


@query
def j12_longest_prefix(f: Facts) -> DataFrame:
    """Files under the deepest known directory: top folders, and those of even nations."""
    tops = f.files.select(F.substring_index("path", "/", 1).alias("prefix"))
    deep = f.files.where("lines % 2 = 0").select(F.regexp_replace("path", "/[^/]*$", "").alias("prefix"))
    return relations.longest_prefix(f.files.select("path"), tops.unionByName(deep).distinct())


@query
def j13_innermost_symbol(f: Facts) -> DataFrame:
    return relations.innermost(f.refs.select("id", "file_id", "line"), f.symbols)


@query
def j14_first_new_on_line(f: Facts) -> DataFrame:
    """Each call with the first ``new`` of its symbol and line."""
    made = f.refs.where("kind = 'new'").groupBy("from_symbol_id", "line").agg(F.min_by("name", "id").alias("event"))
    return f.refs.where("kind = 'call'").join(made, ["from_symbol_id", "line"]).select("id", "from_symbol_id", "line", "event")


@query
def j15_last_annotation(f: Facts) -> DataFrame:
    """The last annotation of each symbol and name."""
    return f.refs.where("kind = 'annotation' and from_symbol_id is not null").groupBy("from_symbol_id", "name").agg(F.max("id").alias("ref_id"))


@query
def j16_tables_to_classes(f: Facts) -> DataFrame:
    """Symbols whose names a table's class names give."""
    tables = f.star("orders").select(F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "_")).alias("t")).distinct()
    words = f.symbols.select(F.concat("name", F.lit("s")).alias("t")).distinct()
    offered = tables.unionByName(words).select("t", F.explode(names.class_names("t")).alias("name"))
    return offered.join(f.symbols.select("name", "id"), "name").select("t", "name", "id").distinct()


@query
def j17_first_model(f: Facts) -> DataFrame:
    """The likeliest model that exists for each table name."""
    tables = f.symbols.select(F.concat("name", F.lit("es")).alias("t")).distinct()
    models = f.symbols.select(names.camelize("name").alias("model")).distinct()
    offered = tables.select("t", F.posexplode(names.candidate_models("t")).alias("pos", "model"))
    return offered.join(models, "model").groupBy("t").agg(F.min_by("model", "pos").alias("model"))


@query
def j18_supertype_links(f: Facts) -> DataFrame:
    return relations.supertype_links(f.symbols, relations.types_view(f.symbols))


@query
def j19_correlated_counts(f: Facts) -> DataFrame:
    """Degree and number of declarations of each symbol's name, both aggregated before they are met."""
    times = f.symbols.groupBy("name").agg(F.count("*").alias("declared"))
    return f.symbols.select("id", "name").join(insight.degrees(f.edges), "id", "left").join(times, "name").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), "declared")


@query
def j20_chain_depth(f: Facts) -> DataFrame:
    return relations.chain_depths(f.refs)


@query
def j21_members(f: Facts) -> DataFrame:
    return relations.members(f.symbols)


@query
def j22_subtypes(f: Facts) -> DataFrame:
    return relations.subtypes(f.edges, f.symbols)


# Projections and predicates


@query
def p2_public_shape(f: Facts) -> DataFrame:
    shown = relations.public_shape(relations.located(f.symbols, f.files))
    return shown.select("id", F.get_json_object("json", "$.fqn").alias("fqn"), F.get_json_object("json", "$.file").alias("file"), F.get_json_object("json", "$.derived").alias("derived"), F.get_json_object("json", "$.isTest").alias("is_test"))


@query
def f5_test_paths(f: Facts) -> DataFrame:
    return f.files.select("path", predicates.is_test_path(F.col("path")).alias("is_test"), names.language("path").alias("lang"))


@query
def f6_arity_fits(f: Facts) -> DataFrame:
    """Symbols and calls of one name, and whether the arguments fit."""
    sites = f.refs.where("kind <> 'annotation'").groupBy("name", F.col("arity").alias("call_arity")).agg(F.count("*").alias("calls"))
    met = relations.located(f.symbols, f.files).join(sites, "name")
    return met.groupBy("id").agg(F.sum(F.when(predicates.arity_fits(F.col("arity"), F.col("signature"), F.col("lang"), F.col("call_arity")), F.col("calls")).otherwise(0)).alias("fitting"), F.sum("calls").alias("calls"))


@query
def f9_framework_and_public(f: Facts) -> DataFrame:
    return f.symbols.select("id", predicates.framework_marked(F.col("annotations"), F.col("modifiers")).alias("framework"), predicates.is_public(F.col("name"), F.col("modifiers")).alias("public"), predicates.is_generated(F.col("modifiers")).alias("generated"))


@query
def f12_routes_without_shadows(f: Facts) -> DataFrame:
    return routing.without_shadows(routing.endpoints(f.bindings, f.symbols, f.files)).select("id", "key", "role")


@query
def f13_edge_groups(f: Facts) -> DataFrame:
    kind, via = F.col("kind"), F.col("via")
    group = F.when(via.startswith("binding:"), "wired").when(kind.isin("calls", "instantiates"), "calls").when(kind.isin("extends", "implements", "includes"), "inherits").otherwise("other")
    return f.edges.groupBy(group.alias("relation")).agg(F.count("*").alias("n"))


@query
def b1_mapper_statements(f: Facts) -> DataFrame:
    return mappers.statement_symbols(mappers.statements(f.mappers)).select("fqn", "signature", "start_line", "end_line", "container_fqn")


@query
def b1_mapper_edges(f: Facts) -> DataFrame:
    found = mappers.statements(f.mappers)
    names = mappers.statement_symbols(found).select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("to_fqn"))
    return mappers.mapped(found, f.symbols)[1].join(names, "to_symbol_id").select("from_symbol_id", "to_fqn", "kind", "confidence", "via", "line")


# Aggregates


@query
def a1_project_stats(f: Facts) -> DataFrame:
    return stats.project_stats(f.files, f.symbols, relations.types_view(f.symbols), f.edges, f.refs, f.unresolved)


@query
def a1_files_by_language(f: Facts) -> DataFrame:
    return stats.files_by_language(f.files)


@query
def a2_resolution(f: Facts) -> DataFrame:
    return stats.resolution(a1_project_stats(f))


@query
def a3_evidence(f: Facts) -> DataFrame:
    return stats.evidence(f.unresolved)


@query
def a4_guessed_links(f: Facts) -> DataFrame:
    return stats.guessed(f.edges)


@query
def a5_floor(f: Facts) -> DataFrame:
    return stats.resolution_floor(a1_project_stats(f), f.unresolved, f.edges)


@query
def a6_endpoint_counts(f: Facts) -> DataFrame:
    return stats.endpoint_counts(f.bindings)


@query
def a7_dependencies(f: Facts) -> DataFrame:
    return stats.dependencies(f.files)


@query
def a8_top_libraries(f: Facts) -> DataFrame:
    return stats.top_libraries(f.unresolved)


@query
def a8_miss_reasons(f: Facts) -> DataFrame:
    return stats.miss_reasons(f.unresolved)


@query
def a8_missed_names(f: Facts) -> DataFrame:
    return stats.missed_names(f.unresolved, f.refs)


@query
def a9_hotspots(f: Facts) -> DataFrame:
    return insight.hotspots(f.edges, f.symbols, f.files)


@query
def a10_degree(f: Facts) -> DataFrame:
    return insight.degrees(f.edges)


@query
def a11_grouped_edges(f: Facts) -> DataFrame:
    return relations.grouped_edges(f.edges, "to_symbol_id", "from_symbol_id").select("of_id", "id", "edge_kind", "confidence", "via", *_joined("lines"))


@query
def a12_types_view(f: Facts) -> DataFrame:
    return relations.types_view(f.symbols).select("fqn", "symbol_id", "kind", *_joined("supertypes"))


@query
def a13_candidate_callers(f: Facts) -> DataFrame:
    return insight.candidate_callers(f.symbols, f.files, f.refs, f.unresolved, (*_joined("lines", "reasons"),))


@query
def a14_candidate_tests(f: Facts) -> DataFrame:
    return insight.candidate_tests(f.symbols, f.symbols, f.files, f.refs, f.unresolved).select("file_path", *_joined("names", "lines"))


@query
def a15_explained(f: Facts) -> DataFrame:
    return insight.explained(f.edges, f.refs, f.unresolved)


@query
def a16_overview(f: Facts) -> DataFrame:
    """Nations as repositories: suppliers' balances as symbols, their share of the best as resolution."""
    repos = f.star("supplier").groupBy("s_nationkey").agg(F.count("*").alias("symbols"), F.sum(F.col("s_suppkey") % 7).alias("edges"), F.round(F.sum(F.col("s_suppkey") % 11) * 10 / F.count("*"), 1).alias("resolution"))
    return stats.overview(repos)


@query
def a18_wired(f: Facts) -> DataFrame:
    return stats.wired(f.edges)


@query
def a19_import_fingerprint(f: Facts) -> DataFrame:
    return stats.import_fingerprint(f.imports)


@query
def a20_unique_names(f: Facts) -> DataFrame:
    return stats.unique_names(f.symbols.where("fqn is not null").select(F.col("fqn").alias("name"), "id"))


# Sorts and limits


@query
def o1_search(f: Facts) -> DataFrame:
    return search.search(relations.located(f.symbols, f.files, own_only=True), "red_w", 20).select("id", "score", "fqn")


@query
def o3_top_hotspots(f: Facts) -> DataFrame:
    return insight.top_hotspots(f.edges, f.symbols, f.files)


@query
def o4_hubs(f: Facts) -> DataFrame:
    return insight.hubs(f.edges, f.symbols, f.files)


@query
def o7_ties(f: Facts) -> DataFrame:
    return search.best_match(relations.located(f.symbols, f.files, own_only=True), "red_widget").select("id", "score", "fqn")


def _of_repositories(f: Facts, rows: DataFrame, file: str = "file_id") -> DataFrame:
    """Files as dealt over four repositories."""
    return rows.withColumn("repo_id", F.concat(F.lit("repo"), (F.col(file) % 4).cast("string")))


@query
def o9_merged_search(f: Facts) -> DataFrame:
    hits = search.scored(relations.located(f.symbols, f.files, own_only=True), "red").where("score is not null")
    placed = _of_repositories(f, hits.select("id", "score", F.coalesce("fqn", "name").alias("fqn")).join(f.symbols.select("id", "file_id"), "id"))
    return views.merged_search(placed.select("repo_id", "id", "score", "fqn"), 25)


def _landing(f: Facts) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.landing(_of_repositories(f, f.symbols), f.edges, f.bindings)


@query
def g15_landing_nodes(f: Facts) -> DataFrame:
    return _landing(f)[0]


@query
def g15_landing_links(f: Facts) -> DataFrame:
    return _landing(f)[1].groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("from_node").alias("sources"), F.countDistinct("to_node").alias("targets"))


@query
def g15_landing_left_out(f: Facts) -> DataFrame:
    return _landing(f)[2]


@query
def g19_symbol_details(f: Facts) -> DataFrame:
    """Of every symbol whose id is divisible by 100."""
    return views.details(f.symbols.where("id % 100 = 0").select("id"), f.symbols, f.files, f.edges, f.raw_edges)


@query
def o10_clamped(f: Facts) -> DataFrame:
    return f.star("events").select("event_id", names.clamp(F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise((F.col("event_id") - 300).cast("string")), 20, 1, 200).alias("limited"))


@query
def s13_search_tiers(f: Facts) -> DataFrame:
    """Every hit of three queries: a member, a name, words."""
    own = relations.located(f.symbols, f.files, own_only=True)
    found = None
    for q in ("T1#red_widget", "Blue_Bolt", "red widget"):
        hits = search.scored(own, q).select(F.lit(q).alias("query"), "id", "score")
        found = hits if found is None else found.unionByName(hits)
    return found


# Sets


@query
def u3_unread_imports(f: Facts) -> DataFrame:
    return f.imports.select("fqn").subtract(f.symbols.where("fqn is not null").select("fqn"))


@query
def u4_missing_paths(f: Facts) -> DataFrame:
    asked = f.star("supplier").select(F.concat(F.lit("lib/n"), F.col("s_nationkey").cast("string"), F.lit("/"), F.regexp_replace("s_name", "#", ""), F.lit(".rb")).alias("path"))
    return graph.missing_paths(asked, f.files)


@query
def u8_kept_edges(f: Facts) -> DataFrame:
    """Edges with both ends among the project's own symbols."""
    own = relations.located(f.symbols, f.files, own_only=True)
    return f.edges.join(own.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi").join(own.select(F.col("id").alias("to_symbol_id")), "to_symbol_id", "left_semi").select("from_symbol_id", "to_symbol_id", "kind", "line")


# Graph


@query
def g2_impact(f: Facts) -> DataFrame:
    """Of every symbol, over all edges. Edges of one key have the same ends, so none has to be left out first."""
    seeds = f.symbols.select(F.col("id").alias("seed"), "id")
    return graph.impact(f.raw_edges, f.symbols, f.files, seeds)


@query
def g3_affected(f: Facts) -> DataFrame:
    """What a change of all Ruby files reaches."""
    return graph.affected(f.edges, f.symbols, f.files, f.files.where("lang = 'ruby'").select("path"))


@query
def g6_shortest_paths(f: Facts) -> DataFrame:
    return graph.paths_from(f.edges, None, 0, containers=relations.containers(f.symbols)).select("id", "depth")


@query
def g8_file_rings(f: Facts) -> DataFrame:
    """Rings of at most three files. Edges of one key have the same ends, so none has to be left out first."""
    found = cycles.rings(relations.file_edges(f.raw_edges, f.symbols, f.files), 2)
    return found.select(F.array_join("ring", " -> ").alias("ring"), "length")


def _module_links(f: Facts) -> DataFrame:
    """Customers as modules of a sparse graph: each needs one near it and one far off."""
    n = f.star("customer").count()
    near = f.star("customer").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") + 1 + F.col("c_nationkey") % 5) % n).cast("long").alias("dst"))
    far = f.star("customer").select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + F.col("c_nationkey")) % n).cast("long").alias("dst"))
    return near.unionByName(far)


@query
def g8_module_rings(f: Facts) -> DataFrame:
    """Rings of up to seven modules."""
    found = cycles.rings(_module_links(f))
    return found.select(F.array_join(F.transform("ring", lambda x: x.cast("string")), " -> ").alias("ring"), "length")


@query
def g8_strong_components(f: Facts) -> DataFrame:
    """Orders as links between the customers of a block: which lie on a common ring."""
    orders = f.star("orders").where("o_orderkey % 7 = 0")
    links = orders.select(F.col("o_custkey").alias("src"), F.expr("o_custkey div 32 * 32 + (o_orderkey * 5 + o_custkey * 3) % 32").alias("dst"))
    return cycles.strong_components(links)


@query
def g9_dead_code(f: Facts) -> DataFrame:
    words = f.star("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1))).alias("word"))
    return insight.dead_code(f.edges, f.bindings, f.symbols, f.files, f.refs, f.unresolved, words)


@query
def g9_held_back(f: Facts) -> DataFrame:
    return insight.held_back(insight.dead_code(f.edges, f.bindings, f.symbols, f.files, f.refs, f.unresolved))


@query
def g17_diagnosis(f: Facts) -> DataFrame:
    wanted = f.imports.join(f.files.select(F.col("id").alias("file_id"), "lang"), "file_id").select("lang", F.col("fqn").alias("name"))
    present = f.symbols.where("fqn is not null").select(F.explode(F.array(*[F.lit(x) for x in names.EXTENSIONS])).alias("lang"), F.col("fqn").alias("name"))
    return insight.diagnosis(wanted, present)


@query
def g18_routes(f: Facts) -> DataFrame:
    return routing.routes(f.bindings, f.symbols, f.files)


# Functions over text


@query
def s3_inflection(f: Facts) -> DataFrame:
    words = f.symbols.select(F.explode(F.array("name", F.concat("name", F.lit("s")), F.concat("name", F.lit("ies")), F.concat("name", F.lit("ches")), F.concat("name", F.lit("us")))).alias("w")).distinct()
    return words.select("w", names.singularize("w").alias("singular"), names.camelize("w").alias("camel"), names.classify("w").alias("class_name"))


@query
def s7_module_paths(f: Facts) -> DataFrame:
    return f.files.select("path", names.module_path("path").alias("module"), names.package_of(F.concat(F.when(F.col("lines") % 2 == 0, "@").otherwise(""), "path")).alias("package"))


@query
def s8_normal_paths(f: Facts) -> DataFrame:
    return f.star("pages").select("page_id", routes.normal_path("url").alias("route"))


@query
def s12_phrases(f: Facts) -> DataFrame:
    return f.star("documents").where(names.has_phrase("text", F.lit("the and"))).select("doc_id")


@query
def s14_lines(f: Facts) -> DataFrame:
    """Lines of each text, and that of its middle."""
    text = F.col("text")
    return f.star("documents").select("doc_id", (F.regexp_count(text, F.lit("\n")) + 1).alias("n_lines"), names.line_of(text, F.floor(F.length(text) / 2).cast("int")).alias("middle"))


@query
def src5_admission(f: Facts) -> DataFrame:
    """Texts refused as too large, binary or packed, and the hash of those admitted."""
    from callweave.sources.files import admission

    return f.star("documents").select("doc_id", admission(F.col("text")).alias("admission"), F.sha1("text").alias("hash"))


@query
def src8_template_words(f: Facts) -> DataFrame:
    from callweave.sources.files import bare_words

    return bare_words(f.star("pages").select(F.col("html").alias("text")))


@query
def st1_sync_status(f: Facts) -> DataFrame:
    """Customers as files: stored ones against a listing in which some vanished and some changed."""
    from callweave.streaming.sync import compared

    stored = f.star("customer").select(F.col("c_name").alias("path"), F.sha1(F.col("c_mktsegment")).alias("hash"))
    listed = f.star("customer").where("c_custkey % 10 <> 0").select(F.when(F.col("c_custkey") % 9 == 0, F.concat("c_name", F.lit(".new"))).otherwise(F.col("c_name")).alias("path"), F.sha1(F.when(F.col("c_custkey") % 7 == 0, F.lit("x")).otherwise(F.col("c_mktsegment"))).alias("hash"))
    return compared(stored, listed).groupBy("status").agg(F.count("*").alias("n"))


# Extraction and resolution, over rendered sources


@query
def ext_java_symbols(f: Facts) -> DataFrame:
    made = Rendered(f).facts
    return made["symbols"].join(made["files"].select(F.col("id").alias("file_id"), "path", "pkg"), "file_id").select("path", "pkg", "fqn", "kind", "container_fqn", "arity", "start_line", F.array_join("params", "|").alias("params"), F.array_join("supertypes", "|").alias("supertypes"))


@query
def ext_java_calls(f: Facts) -> DataFrame:
    made = Rendered(f).facts
    inside = made["symbols"].select(F.col("id").alias("from_symbol_id"), "fqn")
    return made["refs"].join(inside, "from_symbol_id").select("fqn", "name", "receiver", "arity", "line", "kind", F.array_join("str_args", "|").alias("strings"))


@query
def r4_java_edges(f: Facts) -> DataFrame:
    """Inherited members, overloads by argument types, instantiations by import, inheritance."""
    made = Rendered(f)
    edges, _ = made.resolved()
    symbols = made.facts["symbols"]
    ends = edges.join(symbols.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("from_fqn")), "from_symbol_id").join(symbols.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("to_fqn"), F.array_join("params", "|").alias("to_params")), "to_symbol_id")
    return ends.select("from_fqn", "to_fqn", "to_params", "kind", "via", "confidence", "line")


@query
def r2_ancestor_order(f: Facts) -> DataFrame:
    """Rendered interfaces with diamonds: each one's ancestors by place in depth-first preorder."""
    made = Diamonds(f)
    place = F.row_number().over(Window.partitionBy("fqn").orderBy("path")) - 1  # as many rows a type as it has ancestors
    return made.java.chain.select("fqn", "ancestor", place.alias("place"))


@query
def r4_diamond_calls(f: Facts) -> DataFrame:
    """Calls of inherited default methods there: the first ancestor in that order that declares the method is meant."""
    made = Diamonds(f)
    edges, _ = made.resolved()
    fqn = lambda end: made.facts["symbols"].select(F.col("id").alias(f"{end}_symbol_id"), F.col("fqn").alias(f"{end}_fqn"))
    return edges.where("kind = 'calls' and via = 'direct'").join(fqn("from"), "from_symbol_id").join(fqn("to"), "to_symbol_id").select("from_fqn", "to_fqn", "via", "line")


@query
def r17_java_unresolved(f: Facts) -> DataFrame:
    made = Rendered(f)
    _, unresolved = made.resolved()
    refs = made.facts["refs"].select(F.col("id").alias("ref_id"), "from_symbol_id", "name", "line")
    inside = made.facts["symbols"].select(F.col("id").alias("from_symbol_id"), "fqn")
    return unresolved.join(refs, "ref_id").join(inside, "from_symbol_id").select("fqn", "name", "line", "reason", "external", "owner")


@query
def b8_schema_fields(f: Facts) -> DataFrame:
    return Schemas(f).schema.where("kind = 'graphql-field'").select("fqn", "name", "container_fqn", "signature", "start_line", "end_line")


@query
def b8_schema_edges(f: Facts) -> DataFrame:
    """Fields to the methods that annotations and decorators bind to them."""
    return Schemas(f).edges("graphql").drop("container_fqn")


@query
def b9_rpc_methods(f: Facts) -> DataFrame:
    return Schemas(f).schema.where("kind = 'rpc-method'").select("fqn", "name", "container_fqn", "signature", "start_line", "end_line")


@query
def b9_rpc_edges(f: Facts) -> DataFrame:
    """Rpcs to the methods of the types that extend their service's generated base."""
    return Schemas(f).edges("grpc").drop("container_fqn")


@query
def r15_ruby_fallbacks(f: Facts) -> DataFrame:
    """Rendered Ruby: calls by what typed their receivers, down to conventions, ``method_missing`` and unique names."""
    made = RenderedRuby(f)
    edges, _ = made.resolved()
    fqn = lambda end: made.facts["symbols"].select(F.col("id").alias(f"{end}_symbol_id"), F.col("fqn").alias(f"{end}_fqn"))
    return edges.where("kind = 'calls'").join(fqn("from"), "from_symbol_id").join(fqn("to"), "to_symbol_id").select("from_fqn", "to_fqn", "via", "confidence", "line")
