"""Composed views over one or several repositories: merged search, the landing graph, everything about a symbol.

The best of each repository are taken by a ranked window, whose limit Spark applies within the tasks before the shuffle, so a repository
with most rows sends no more than its best from each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.predicates import CALLABLE_KINDS
from callweave.operators.graph import impact
from callweave.operators.insight import degrees
from callweave.operators.relations import containers, cross_repo_pairs, grouped_edges

CALLS, INHERITS = ["calls", "instantiates"], ["extends", "implements", "includes"]
HUB_KINDS = ["class", "interface", "module", "record"]


def best_of_each(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")


def merged_search(hits: DataFrame, limit: int = 40) -> DataFrame:
    """``hits(repo_id, id, score, fqn)``: the best ``limit`` of each repository, merged, and the best ``limit`` of these."""
    order = [F.desc("score"), F.col("fqn"), F.col("repo_id"), F.col("id")]
    return best_of_each(hits, "repo_id", [c for c in order], limit).orderBy(*order).limit(limit)


def repository_hubs(symbols: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """``repo_id, id, degree``: the types that most edges touch in each repository; where none has edges callables, else types of degree 0."""
    every = symbols.where("fqn is not null").where(F.col("kind").isin(*HUB_KINDS, *CALLABLE_KINDS)).select("repo_id", "id", "name", "kind").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    types = F.col("kind").isin(*HUB_KINDS)
    ranked = every.withColumn("tier", F.when(types & (F.col("degree") > 0), 0).when(F.col("degree") > 0, 1).when(types, 2)).where("tier is not null")
    best = ranked.groupBy("repo_id").agg(F.min("tier").alias("tier"))
    return best_of_each(ranked.join(best, ["repo_id", "tier"], "left_semi"), "repo_id", [F.desc("degree"), F.col("name"), F.col("id")], limit).select("repo_id", "id", "degree")


def landing(symbols: DataFrame, edges: DataFrame, bindings: DataFrame, hubs: int = 10, endpoints: int = 60) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole workspace's shape: ``(nodes, links, left_out)``.

    ``symbols`` and ``bindings`` carry ``repo_id``. Nodes (``node, repo_id, kind``) are repositories, their hubs, at most ``endpoints`` endpoints of each
    (the least ids) and what these are linked with in other repositories; links (``from_node, to_node, kind, confidence``) have both ends among
    them. ``left_out`` counts, by repository, the endpoints beyond the limit.
    """
    node = lambda repo, i: F.concat_ws(":", repo, i)
    repos = symbols.select("repo_id").distinct()
    top = repository_hubs(symbols, edges, hubs)
    bound = bindings.where("symbol_id is not null").select(F.col("symbol_id").alias("id")).distinct().join(symbols.select("repo_id", "id"), "id")
    shown = best_of_each(bound, "repo_id", [F.col("id")], endpoints)
    left_out = bound.groupBy("repo_id").agg(F.count("*").alias("endpoints")).select("repo_id", "endpoints", F.greatest(F.col("endpoints") - endpoints, F.lit(0)).alias("left_out"))
    seeds = top.select("repo_id", "id").unionByName(shown.select("repo_id", "id")).distinct()
    where = symbols.select(F.col("id").alias("from_symbol_id"), F.col("repo_id").alias("own"))
    # a binding belongs to the repository of its symbol
    owned = bindings.drop("repo_id").where("symbol_id is not null").join(where.select(F.col("from_symbol_id").alias("symbol_id"), F.col("own").alias("repo_id")), "symbol_id")
    ours = cross_repo_pairs(owned, seeds.select(F.col("id").alias("symbol_id"))).select("from_repo", "from_symbol_id", "to_repo", "to_symbol_id").distinct()
    far = ours.select(F.col("from_repo").alias("repo_id"), F.col("from_symbol_id").alias("id")).unionByName(ours.select(F.col("to_repo").alias("repo_id"), F.col("to_symbol_id").alias("id"))).distinct()
    kinds = [repos.select(F.concat(F.lit("repo:"), "repo_id").alias("node"), "repo_id", F.lit(0).alias("rank"))]
    kinds += [rows.select(node("repo_id", "id").alias("node"), "repo_id", F.lit(k).alias("rank")) for k, rows in enumerate((top, shown, far), 1)]
    nodes = reduce(DataFrame.unionByName, kinds).groupBy("node", "repo_id").agg(F.min("rank").alias("rank"))
    nodes = nodes.select("node", "repo_id", F.element_at(F.array(*map(F.lit, ("repo", "hub", "endpoint", "linked"))), F.col("rank") + 1).alias("kind"))
    contains = seeds.select(F.concat(F.lit("repo:"), "repo_id").alias("from_node"), node("repo_id", "id").alias("to_node"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    end = lambda c: top.select(F.col("id").alias(c), F.col("repo_id").alias(f"{c}_repo"))
    between = edges.where("from_symbol_id <> to_symbol_id").join(end("from_symbol_id"), "from_symbol_id").join(end("to_symbol_id"), "to_symbol_id").where("from_symbol_id_repo = to_symbol_id_repo")
    drawn = between.groupBy("from_symbol_id", "to_symbol_id", "kind", "from_symbol_id_repo").agg(F.max("confidence").alias("confidence")).select(node("from_symbol_id_repo", "from_symbol_id").alias("from_node"), node("from_symbol_id_repo", "to_symbol_id").alias("to_node"), "kind", "confidence")
    across = ours.select(node("from_repo", "from_symbol_id").alias("from_node"), node("to_repo", "to_symbol_id").alias("to_node"), F.lit("binds").alias("kind"), F.lit(0.85).alias("confidence"))
    return nodes, contains.unionByName(drawn).unionByName(across), left_out


def details(asked: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """One row for each of ``asked(id)``: how many members, callers, callees, endpoints wired to and from it, related types, and symbols and files that a change reaches.

    ``links`` may give the ends of all edges where these are known without working the edges out.
    """
    into = grouped_edges(edges, "to_symbol_id", "from_symbol_id").join(asked.select(F.col("id").alias("of_id")), "of_id", "left_semi").withColumn("way", F.lit("in"))
    out = grouped_edges(edges, "from_symbol_id", "to_symbol_id").join(asked.select(F.col("id").alias("of_id")), "of_id", "left_semi").withColumn("way", F.lit("out"))
    called, inherits, bound = F.col("edge_kind").isin(*CALLS), F.col("edge_kind").isin(*INHERITS), F.col("via").startswith("binding:")
    way = lambda w, cond: F.count(F.when((F.col("way") == w) & cond, 1))
    near = into.unionByName(out).groupBy(F.col("of_id").alias("id")).agg(way("in", called).alias("callers"), way("out", called).alias("callees"), way("in", bound).alias("wired_in"), way("out", bound).alias("wired_out"), F.count(F.when(inherits, 1)).alias("related"))
    types, inside = containers(symbols)
    sizes = inside.groupBy("container").agg(F.count("*").alias("members"))  # members meet their types as a number; in pairs they would be the square of a container
    own = types.join(asked.select("id"), "id", "left_semi").join(sizes, "container").select("id", "members")
    blast = impact(edges if links is None else links, symbols, files, asked.select(F.col("id").alias("seed"), "id")).select(F.col("seed").alias("id"), F.col("total_symbols").alias("blast_symbols"), F.col("total_files").alias("blast_files"))
    rows = asked.select("id").join(near, "id", "left").join(own, "id", "left").join(blast, "id", "left")
    return rows.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("members", "callers", "callees", "wired_in", "wired_out", "related", "blast_symbols", "blast_files")])
