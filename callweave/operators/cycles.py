"""Strongly connected components and rings of a directed graph (``src, dst``)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.blocks import TASKS, numbered, read
from callweave.plans.scratch import Scratch

#: Links of a tile of the graph, about; ways of two links looked at in a step; bytes of a tile as bits.
TILE, WAYS, BITS = 1 << 19, 1 << 18, 1 << 26
WIDE = np.int64(1) << 32


def trimmed(links: DataFrame, scratch: Scratch, rounds: int = 1 << 30) -> DataFrame:
    """``links`` without nodes that nothing leads to or that lead nowhere, again and again: no ring holds them."""
    now = scratch.save(links)
    n = now.count()
    for _ in range(rounds):
        after = scratch.save(now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        scratch.drop(now)
        now, before = after, n
        n = now.count()
        if n == before:
            break
    return now


def _spread(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, color``: the least label that reaches a node, itself included. Each round sends on only what fell in the last."""
    now, fell = labels, labels
    while True:
        sent = fell.join(links.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("new"))
        after = scratch.save(now.join(sent, "id", "left").select("id", F.least("color", F.coalesce("new", "color")).alias("color"), (F.col("new") < F.col("color")).alias("fell")))
        fell = after.where("fell").select("id", "color")
        if fell.isEmpty():
            return after.select("id", "color")
        now = after.select("id", "color")


def _back(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, color``: what reaches its color's root within the color. ``links`` has both ends of one color."""
    found = frontier = roots
    while True:
        new = frontier.join(links.withColumnRenamed("dst", "id"), "id").select(F.col("src").alias("id"), "color").distinct().join(found.select("id"), "id", "left_anti")
        frontier = scratch.save(new)
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)


def strong_components(links: DataFrame) -> DataFrame:
    """``id, component, size`` of every node that lies on a ring; component is its least node.

    Forward, the least node that reaches it colors each node; backward from such a node, what reaches it within its color is its
    component. What is left is trimmed and colored anew. Every step is a join on edges or nodes, written to the shared folder;
    no component is gathered. Rounds grow with the longest way within a component. Self-loops and repeats are left out; an empty graph gives none.
    """
    scratch = Scratch(links.sparkSession)
    now = trimmed(links.select("src", "dst").where("src <> dst").distinct(), scratch)
    found: list[DataFrame] = []
    while not now.isEmpty():
        nodes = now.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colors = _spread(scratch.save(nodes.withColumn("color", F.col("id"))), now, scratch)
        of = lambda end: colors.select(F.col("id").alias(end), F.col("color").alias(f"{end}_color"))  # noqa: E731,B023
        within = scratch.save(now.join(of("src"), "src").join(of("dst"), "dst").where("src_color = dst_color").select("src", "dst"))
        part = scratch.save(_back(scratch.save(colors.where("id = color")), within, scratch))
        found.append(part)
        rest = within.join(part.select(F.col("id").alias("src")), "src", "left_anti").join(part.select(F.col("id").alias("dst")), "dst", "left_anti")
        now = trimmed(rest, scratch)
    if not found:
        return links.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(1).cast("long").alias("size")).limit(0)
    every = reduce(DataFrame.unionByName, found).withColumnRenamed("color", "component")
    sizes = every.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return every.join(sizes, "component").select("id", "component", "size")


def rings(links: DataFrame, max_length: int = 6) -> DataFrame:
    """``ring, length``: each simple cycle of at most ``max_length`` + 1 nodes once, from its least node.

    Nodes that nothing leads to or that lead nowhere are left out first, a few rounds of them; strong components would take a round for
    each step of their longest way, and a half path is short. A ring of n nodes from its least one is a half path of ceil(n / 2) edges
    away from that node and one of the rest into it, which share their other end alone: both kinds are grown once and met for each n.
    Rings of at most three nodes need no stored ways, of which a dense graph has far more than rings.
    """
    if max_length <= 2:
        return _short_rings(links.select("src", "dst").where("src <> dst").distinct(), max_length + 1)
    scratch = Scratch(links.sparkSession)
    live = trimmed(links.select("src", "dst").where("src <> dst").distinct(), scratch, rounds=3)
    most = max_length + 1
    away = _halves(live, (most + 1) // 2, scratch)
    into = _halves(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")), most // 2, scratch)
    found = []
    for n in range(2, most + 1):
        one, two = away[(n + 1) // 2], into[n // 2].select("start", "at", F.col("path").alias("back"))
        met = one.join(two, ["start", "at"])
        if n > 2:  # the back half, read from the shared end on; that end is in both
            met = met.where(F.size(F.array_intersect("path", "back")) == 1)
        found.append(met.select(F.concat(F.array("start"), "path", F.slice(F.reverse("back"), 2, n)).alias("ring")))
    return reduce(DataFrame.unionByName, found).select("ring", F.size("ring").alias("length"))


def _halves(links: DataFrame, most: int, scratch: Scratch) -> dict[int, DataFrame]:
    """By number of edges: ``start, at, path``, the simple paths from each node over greater ones; ``path`` leaves the start out."""
    now = scratch.save(links.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("dst").alias("path")))
    out = {1: now}
    steps = links.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    for k in range(2, most + 1):
        grown = now.join(steps, "at").where("next > start").where(~F.array_contains("path", F.col("next")))
        now = out[k] = scratch.save(grown.select("start", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path")))
    return out


def _short_rings(links: DataFrame, most: int) -> DataFrame:
    """Rings of two and three nodes. Nodes are numbered in their order and dealt over p parts, links over the p x p tiles between parts.

    A ring a, b, c lies in three tiles: a task takes a triple of parts, reads the three tiles and their nodes' names from the shared folder, and looks for each
    way from a over b to c whether a link leads back. Ways are made in steps and never stored.
    """
    scratch = Scratch(links.sparkSession)
    live = scratch.save(links)
    nodes = numbered(live.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), [F.col("id")], scratch)
    p = isqrt(max(0, live.count() - 1) // TILE) + 1
    number = lambda c: nodes.select(F.col("id").alias(c), F.expr(f"cast(at % {p} as int) as {c}_part"), F.expr(f"cast(at div {p} as int) as {c}_at"))
    dealt = live.join(number("src"), "src").join(number("dst"), "dst").select(F.expr(f"src_part * {p} + dst_part").alias("tile"), F.col("src_at").alias("src"), F.col("dst_at").alias("dst"))
    tiles, names = scratch.path(), scratch.path()
    dealt.repartitionById(p * p, "tile").sortWithinPartitions("tile", "src", "dst").write.partitionBy("tile").parquet(tiles)
    nodes.select("id", F.expr(f"cast(at % {p} as int)").alias("part"), F.expr(f"cast(at div {p} as int)").alias("at")).repartitionById(p, "part").sortWithinPartitions("part", "at").write.partitionBy("part").parquet(names)
    kind = links.schema["src"].dataType.simpleString()

    def tile(x: int, y: int) -> list[np.ndarray]:
        got = pa.Table.from_batches(read(tiles, ["src", "dst"], below=f"/tile={x * p + y}"), pa.schema([("src", pa.int32()), ("dst", pa.int32())]))
        return [c.to_numpy() for c in got.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                i, j, k = cell // (p * p), cell // p % p, cell % p
                called = {x: pa.concat_arrays([t.column(0) for t in read(names, ["id"], below=f"/part={x}")]) for x in {i, j, k}}
                a, b = tile(i, j)
                up = a * np.int64(p) + i < b * np.int64(p) + j  # from the least node
                a, b = a[up], b[up]
                if k == 0:
                    src, dst = tile(j, i)
                    back = np.isin(b * WIDE + a, src * WIDE + dst)
                    yield from _named([called[i], called[j]], [a[back], b[back]])
                if most > 2:
                    for ends in _thirds(a, b, tile(j, k), tile(k, i), (i, k)):
                        yield from _named([called[i], called[j], called[k]], ends)

    cells = links.sparkSession.range(0, p**3, 1, min(p**3, TASKS))
    return cells.mapInArrow(run, f"ring array<{kind}>, length int")


def _named(called: list[pa.Array], ends: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rings by their nodes' names."""
    n, size = len(ends[0]), len(ends)
    if n:
        flat = pa.concat_arrays([names.take(pa.array(at)) for names, at in zip(called, ends, strict=True)])
        turned = flat.take(pa.array(np.arange(size * n).reshape(size, n).T.ravel()))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, size * n + 1, size), pa.int32()), turned), pa.array(np.full(n, size), pa.int32())], ["ring", "length"])


def _thirds(a: np.ndarray, b: np.ndarray, on: list[np.ndarray], back: list[np.ndarray], parts: tuple[int, int]) -> Iterator[list[np.ndarray]]:
    """Of links a to b the ways on to c, greater than a, from where a link leads back to a. ``on`` and ``back`` are sorted; numbers are those within the parts."""
    if not (len(a) and len(on[0]) and len(back[0])):
        return
    i, k = parts
    on_key = on[0] * WIDE + on[1]
    begin = np.searchsorted(on_key, b * WIDE + a + (k <= i))  # within parts, c may equal a where its part is a later one
    many = np.searchsorted(on[0], b, "right") - begin
    rows, columns = int(max(back[1].max(), a.max())) + 1, int(max(back[0].max(), on[1].max())) // 8 + 1
    bits = None
    if rows * columns <= BITS:
        bits = np.zeros(rows * columns, np.uint8)
        np.bitwise_or.at(bits, back[1] * np.int64(columns) + (back[0] >> 3), np.left_shift(1, back[0] & 7).astype(np.uint8))
    back_key = back[0] * WIDE + back[1]
    ends = np.cumsum(many)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WAYS, "right")))
        n = many[at:to]
        link = np.repeat(np.arange(at, to), n)
        c = on[1][np.arange(len(link)) + np.repeat(begin[at:to] - (ends[at:to] - n - (ends[at - 1] if at else 0)), n)]
        x = a[link]
        if bits is not None:
            hit = np.flatnonzero(bits[x * np.int64(columns) + (c >> 3)] >> (c & 7).astype(np.uint8) & 1)
        else:
            key = c * WIDE + x
            place = np.searchsorted(back_key, key)
            hit = np.flatnonzero(back_key[np.minimum(place, len(back_key) - 1)] == key)
        yield [x[hit], b[link[hit]], c[hit]]
        at = to
