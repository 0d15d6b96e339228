"""Bounded traversals: one join a level for all frontiers at once, every level cut from its lineage in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.predicates import is_test_path
from callweave.operators import blocks
from callweave.operators.relations import neighbours
from callweave.plans.scratch import Scratch


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, backwards: bool = True) -> DataFrame:
    """``seed, id, depth``: what each seed reaches, each once and at its least depth, the seed left out.

    ``seeds`` has ``seed`` and ``id`` (several ids may stand for one seed: then it is their joint reach).
    """
    scratch = Scratch(edges.sparkSession)
    near, far = ("to_symbol_id", "from_symbol_id") if backwards else ("from_symbol_id", "to_symbol_id")
    steps = scratch.save(edges.select(F.col(near).alias("id"), F.col(far).alias("next")).where("id <> next").distinct())
    seen = scratch.save(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        found = frontier.join(steps, "id").select("seed", F.col("next").alias("id")).distinct()
        frontier = scratch.save(found.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


#: Seeds of a block: so many words of 64 bits a row.
WORDS = 16
#: Edges times blocks of a round of ``impact``, which bounds what a level shuffles and stores.
ROUND = 1 << 25


def _words(make) -> list[Column]:
    return [F.expr(make(f"b{i}", i)).alias(f"b{i}") for i in range(WORDS)]


def numbered(seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """``seed, block, bit``: blocks hold at most 64 x ``WORDS`` seeds."""
    at = scratch.save(scratch.save(seeds.select("seed").distinct()).select("seed", F.monotonically_increasing_id().alias("at")))
    return scratch.save(at.selectExpr("seed", f"at div {64 * WORDS} as block", f"cast(at % {64 * WORDS} as int) as bit"))


def _started(seeds: DataFrame, number: DataFrame) -> DataFrame:
    return seeds.select("seed", "id").join(number, "seed").groupBy("block", "id").agg(*_words(lambda b, i: f"coalesce(bit_or(case when bit div 64 = {i} then shiftleft(1L, cast(bit % 64 as int)) end), 0L)"))


def _steps(edges: DataFrame, backwards: bool = True) -> DataFrame:
    near, far = ("to_symbol_id", "from_symbol_id") if backwards else ("from_symbol_id", "to_symbol_id")
    return edges.select(F.col(near).alias("id"), F.col(far).alias("next")).where("id <> next").distinct()


def reached_bits(edges: DataFrame, seeds: DataFrame, max_depth: int = 4, backwards: bool = True) -> tuple[DataFrame, DataFrame]:
    """The reach of very many seeds at once: ``(number, hits)``, number giving each ``seed`` its ``block`` and ``bit``; for ``hits`` see ``_reach``."""
    scratch = Scratch(edges.sparkSession)
    number = numbered(seeds, scratch)
    return number, _reach(scratch.save(_steps(edges, backwards)), _started(seeds, number), scratch, max_depth)


def _reach(steps: DataFrame, started: DataFrame, scratch: Scratch, max_depth: int = 4) -> DataFrame:
    """Over ``steps(id, next)``: ``block, id, depth`` and words of bits, the seeds of the block that reach ``id`` at that least depth.

    ``started`` has ``block, id`` and the words. A level joins the frontier with the edges, merges what arrives by ``bit_or``, within the
    tasks first, and takes out what was there: all seeds of a block cost the rows of one.
    """
    seen = frontier = scratch.save(started)
    levels = []
    for depth in range(1, max_depth + 1):
        arrived = frontier.join(steps, "id").groupBy("block", F.col("next").alias("id")).agg(*_words(lambda b, i: f"bit_or({b})"))
        before = seen.select("block", "id", *_words(lambda b, i: b)).withColumnsRenamed({f"b{i}": f"old{i}" for i in range(WORDS)})
        fresh = arrived.join(before, ["block", "id"], "left").select("block", "id", *_words(lambda b, i: f"{b} & ~coalesce(old{i}, 0L)"))
        frontier = scratch.save(fresh.where(" | ".join(f"b{i}" for i in range(WORDS)) + " <> 0"))
        if frontier.isEmpty():
            scratch.drop(frontier)
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        if depth < max_depth:
            merged = scratch.save(seen.unionByName(frontier).groupBy("block", "id").agg(*_words(lambda b, i: f"bit_or({b})")))
            scratch.drop(seen)
            seen = merged
    none = started.withColumn("depth", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, levels, none)


def _each_bit(hits: DataFrame) -> DataFrame:
    """One row a bit: its number in the block."""
    words = F.posexplode(F.array(*[f"b{i}" for i in range(WORDS)])).alias("word", "bits")
    rest = [c for c in hits.columns if c not in {f"b{i}" for i in range(WORDS)}]
    return hits.select(*rest, words).where("bits <> 0").withColumn("bit", F.explode(F.expr("transform(filter(sequence(0, 63), i -> (bits & shiftleft(1L, i)) <> 0), i -> word * 64 + i)"))).drop("word", "bits")


def impact(edges: DataFrame, symbols: DataFrame, files: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """For every seed: symbols and files reached, and symbols a level.

    While a task can hold a word of seeds for every node, blocks of seeds are searched each within a task; for larger graphs their rows are joined and shuffled.
    """
    scratch = Scratch(edges.sparkSession)
    places = scratch.save(symbols.select("id", "file_id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path"))
    steps = scratch.save(_steps(edges))
    ends = scratch.save(steps.select(F.explode(F.array("id", "next")).alias("id")).distinct())
    n = ends.count()
    return blocks.impact(steps, places, seeds, ends, n, max_depth, scratch) if blocks.fits(n) else _impact_in_rounds(steps, places, seeds, max_depth, scratch)


def _impact_in_rounds(steps: DataFrame, places: DataFrame, seeds: DataFrame, max_depth: int, lasting: Scratch) -> DataFrame:
    """Bits part only within the tasks that count them. Blocks of seeds are taken in rounds of bounded size, and a round's tables are deleted before the next."""
    number = numbered(seeds, lasting)
    every = sorted(r[0] for r in number.select("block").distinct().collect())  # one for 1,024 seeds
    size = max(1, ROUND // max(1, steps.count()))
    levels = [F.count(F.when(F.col("depth") == d, 1)).alias(f"level_{d}") for d in range(1, max_depth + 1)]
    key, out = ["block", "bit"], []
    for at in range(0, len(every), size):
        scratch = Scratch(steps.sparkSession)
        part = number.where(F.col("block").isin(every[at : at + size]))
        placed = scratch.save(_reach(steps, _started(seeds, part), scratch, max_depth).join(places, "id"))
        by_symbol = _each_bit(placed).groupBy(*key).agg(F.count("*").alias("total_symbols"), *levels)
        by_file = _each_bit(placed.groupBy("block", "path").agg(*_words(lambda b, i: f"bit_or({b})"))).groupBy(*key).agg(F.count("*").alias("total_files"))
        out.append(lasting.save(part.join(by_symbol, key).join(by_file, key).select("seed", "total_symbols", "total_files", *[f"level_{d}" for d in range(1, max_depth + 1)])))
        scratch.delete(scratch.root)
    none = number.selectExpr("seed", "0L as total_symbols", "0L as total_files", *[f"0L as level_{d}" for d in range(1, max_depth + 1)]).limit(0)
    return reduce(DataFrame.unionByName, out, none)


def affected(edges: DataFrame, symbols: DataFrame, files: DataFrame, paths: DataFrame, max_depth: int = 4) -> DataFrame:
    """``id, path, depth, is_test``: what a change of ``paths`` reaches outside the changed files.

    One traversal from all changed symbols: what lies near any lies near the nearest.
    """
    at = symbols.where("kind <> 'file'").join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path")
    changed = at.join(paths.select("path").distinct(), "path", "left_semi").select(F.lit(0).alias("seed"), "id")
    return reached(edges, changed, max_depth).join(at, "id").select("id", "path", "depth", is_test_path(F.col("path")).alias("is_test"))


def untested(changed_production: int, tests_reached: int) -> bool:
    """Production code changed and no test reaches it."""
    return changed_production > 0 and tests_reached == 0


def missing_paths(paths: DataFrame, files: DataFrame) -> DataFrame:
    return paths.select("path").distinct().join(files.select("path"), "path", "left_anti")


def paths_from(edges: DataFrame, structure: DataFrame | None, source: int, max_depth: int = 12, containers: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``id, depth, parent, kind, via``: a shortest directed path from ``source`` to all it reaches, types flowing into their members.

    Of several shortest ways the one over the least parent, then kind and via, is kept. In place of ``structure``'s pairs ``containers`` may
    give types and members (``id, container``), whose pairs are never made: of a container's types the least of a level opens it.
    """
    scratch = Scratch(edges.sparkSession)
    hops = edges.select(F.col("from_symbol_id").alias("id"), F.col("to_symbol_id").alias("next"), "kind", "via")
    if structure is not None:
        hops = hops.unionByName(structure.select(F.col("type_id").alias("id"), F.col("member_id").alias("next"), F.lit("declares").alias("kind"), F.lit("structure").alias("via")))
    if containers:
        types, inside = scratch.save(containers[0].select("id", "container")), scratch.save(containers[1].select(F.col("id").alias("next"), "container"))
    hops = scratch.save(hops.groupBy("id", "next").agg(F.min(F.struct("kind", "via")).alias("hop")))
    seen = frontier = scratch.save(edges.sparkSession.range(source, source + 1).select("id", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("via")))
    for depth in range(1, max_depth + 1):
        met = frontier.select("id").join(hops, "id").select("next", F.struct(F.col("id").alias("parent"), "hop").alias("m"))
        if containers:
            opened = frontier.select("id").join(types, "id").groupBy("container").agg(F.min("id").alias("parent"))
            declared = F.struct(F.lit("declares").alias("kind"), F.lit("structure").alias("via")).alias("hop")
            met = met.unionByName(opened.join(inside, "container").select("next", F.struct("parent", declared).alias("m")))
        found = met.groupBy("next").agg(F.min("m").alias("m"))
        fresh = found.select(F.col("next").alias("id"), F.lit(depth).alias("depth"), "m.parent", "m.hop.kind", "m.hop.via").join(seen.select("id"), "id", "left_anti")
        frontier = scratch.save(fresh.select("id", "depth", "parent", "kind", "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path_between(edges: DataFrame, structure: DataFrame, source: int, target: int, max_depth: int = 12) -> list[dict] | None:
    """The hops of a shortest path, none for a symbol to itself, None if there is none. A type is reached with any of its members."""
    if source == target:
        return []
    tree = paths_from(edges, structure, source, max_depth)
    goals = structure.where(F.col("type_id") == target).select(F.col("member_id").alias("id")).unionByName(edges.sparkSession.range(target, target + 1)).distinct()
    end = tree.where("depth > 0").join(goals, "id", "left_semi").orderBy("depth", "id").first()
    hops: list[dict] = []
    while end is not None and end["depth"] > 0:  # at most max_depth rows of one path
        hops.insert(0, {"id": end["id"], "kind": end["kind"], "via": end["via"]})
        end = tree.where(F.col("id") == end["parent"]).first()
    return hops or None


def path_across(edges_a: DataFrame, edges_b: DataFrame, pairs: DataFrame, source: int, target: int, none: DataFrame) -> int | None:
    """The least number of hops from a symbol of one repository over an endpoint pair (``mine, theirs``) to a symbol of another."""
    there = paths_from(edges_a, none, source).select(F.col("id").alias("mine"), F.col("depth").alias("d1"))
    turned = edges_b.select(F.col("to_symbol_id").alias("from_symbol_id"), F.col("from_symbol_id").alias("to_symbol_id"), "kind", "via")
    back = paths_from(turned, none, target).select(F.col("id").alias("theirs"), F.col("depth").alias("d2"))
    return pairs.join(there, "mine").join(back, "theirs").agg(F.min(F.col("d1") + F.col("d2") + 1)).first()[0]


def around(edges: DataFrame, structure: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 160) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (``id, level``), edges between them, and whether the cap cut any: breadth first, strongest edge first, then least id."""
    scratch = Scratch(edges.sparkSession)
    inside = structure.join(seeds.select(F.col("id").alias("type_id")), "type_id", "left_semi")
    first = seeds.select("id", F.lit(0).alias("level")).distinct()
    extra = inside.select(F.col("member_id").alias("id")).distinct().join(first, "id", "left_anti")
    kept = first.count()
    more = extra.count()
    nodes = scratch.save(first.unionByName(extra.orderBy("id").limit(max(0, max_nodes - kept)).withColumn("level", F.lit(0))))
    truncated, kept = more > max_nodes - kept, min(max(kept, max_nodes), kept + more)
    near = neighbours(edges)
    frontier = nodes
    for level in range(1, depth + 1):
        found = near.join(frontier.select("id"), "id", "left_semi").groupBy(F.col("other").alias("id")).agg(F.max("confidence").alias("c")).join(nodes, "id", "left_anti")
        n = found.count()
        frontier = scratch.save(found.orderBy(F.desc("c"), "id").limit(max(0, max_nodes - kept)).select("id", F.lit(level).alias("level")))
        truncated, kept = truncated or n > max_nodes - kept, min(kept + n, max(kept, max_nodes))
        nodes = scratch.save(nodes.unionByName(frontier))
        if n == 0:
            break
    declared = inside.select(F.col("type_id").alias("from_symbol_id"), F.col("member_id").alias("to_symbol_id"), F.lit("declares").alias("kind"))
    every = edges.select("from_symbol_id", "to_symbol_id", "kind").unionByName(declared).distinct()
    ends = lambda c: nodes.select(F.col("id").alias(c))
    return nodes, every.join(ends("from_symbol_id"), "from_symbol_id", "left_semi").join(ends("to_symbol_id"), "to_symbol_id", "left_semi"), truncated


def rotated(ring: Column) -> Column:
    """An array turned so that its least element comes first."""
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at - 1))


