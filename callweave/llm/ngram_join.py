"""Similarity join on word n-grams: Jaccard of shingle sets, by rare-first prefix filtering.

Documents of one shingle set form a class; a class is known by its least doc_id. Two classes
link when 100 * |intersection| >= percent * |union|. The result is the connected component of every
document, which needs every link between components but not each link within one.

1. Shingles are counted over all documents in a sketch of ``CELLS`` cells (a table of fixed
   size, the only one that is broadcast). The global order is by cell count, then by hash: rare first.
   Any total order gives exact results; this one keeps common passages out of prefixes.
2. A set's first n - ceil(percent/100 * n) + 1 shingles are its prefix. Linked sets share a prefix
   shingle, and at the first of them pass the length and the positional filter.
3. Star rounds: for each prefix shingle some of its sets, chosen by hash in a map-side aggregate, are
   centers, and every other set of it is paired with these alone: work in proportion to the rows, whatever the
   group's size. Pairs that pass the suffix filter are verified once and merged into components.
4. Where a sketch of fixed size can't tell common shingles from rare ones, real counts do: shingles that, after the stars,
   lie in the prefixes of more than ``MANY`` components are put last in the order, with all else that so many of their holders
   have, and every set whose prefix holds any of them chooses its prefix anew, until no new shingle lies in so many. A prefix that
   holds none is the same in both orders, so one order holds for all, whatever ``MANY`` is.
5. The last round takes, for shingles whose sets still lie in several components, every pair
   across components that passes the filters, not verified before. Pairs within a component are never made, so a
   large group of near copies, united by the stars, costs no square of its size.

The suffix filter bounds the overlap by what the counts in ``PARTS`` hash ranges have in common. No shingle's rows and no
component is gathered in a task: joins on hot shingles are plain equi-joins that adaptive execution splits (salted
joins were measured: twice the shuffle, see the README). Each set that is verified is built once and kept for all rounds.

Words are runs without white space, A-Z lower-cased. A text of fewer words than n is one shingle. Null and
empty texts have no set, no link, and their own id as component. Null doc_ids link with nothing and have no
component. Rows that share a doc_id count as one node. Texts of any length are read whole: memory grows with the longest.
Other columns, whatever their names, play no part. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch
from callweave.llm.components import components

CELLS, PARTS, CENTERS, ROUNDS, CACHE = 1 << 18, 64, 3, 2, 150_000
#: In how many components a prefix shingle may lie before it is put last.
MANY = 10_000
#: Cells of the node filter that spares most texts the verification's shuffle.
NODE_CELLS = 1 << 18
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Hashes(dict):
    """Word to 64 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, n: int, hashes: Hashes) -> np.ndarray:
    """The distinct n-word shingles' hashes, ascending."""
    words = text.encode().lower().split() if text else ()  # of bytes: A-Z and ASCII white space alone
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
    w = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    x = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        x *= M1
        x += w[k : len(w) - n + 1 + k]
        x ^= x >> np.uint64(32)
        x *= M2
        x ^= x >> np.uint64(29)
    return np.unique(x)


def least_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def cell_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many documents the shingles of each cell occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held, size = Hashes(), np.zeros(CELLS, np.int64), [], 0
        for b in batches:
            for t in b.column(0):
                held.append(shingles(t.as_py(), n, hashes))
                size += len(held[-1])
                if size >= 1 << 20:
                    counts += np.bincount(cells(np.concatenate(held)), minlength=CELLS)
                    held, size = [], 0
        if held:
            counts += np.bincount(cells(np.concatenate(held)), minlength=CELLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["cell", "n"])

    got = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def cells(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def signatures(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``doc_id, n`` (set size), ``d1, d2`` (the set's digest), ``prefix`` (rare first), ``parts`` (how many lie in each hash range)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(), shared.value
        for b in batches:
            sizes, d1, d2, prefixes, parts = [], [], [], [], []
            for t in b.column(1):
                x = shingles(t.as_py(), n, hashes)
                sizes.append(len(x))
                one, two = digest(x)
                d1.append(one)
                d2.append(two)
                prefixes.append(prefix(x, percent, counts).view(np.int64))
                parts.append(np.bincount((x & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(prefixes, pa.int64()), _lists(parts, pa.int32())], ["doc_id", "n", "d1", "d2", "prefix", "parts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, prefix array<long>, parts array<int>")


def digest(x: np.ndarray) -> tuple[int, int]:
    found = xxhash.xxh3_128_digest(x.tobytes())
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def prefix(x: np.ndarray, percent: int, counts: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The prefix of set ``x``, rare first; those in ``last`` after all others."""
    keys = (x, counts[cells(x)])
    keep = len(x) - least_overlap(len(x), percent) + 1 if len(x) else 0
    return x[np.lexsort(keys if last is None else (*keys, np.isin(x, last)))[:keep]]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.array([], np.int64), kind))


def _passes(percent: int, n: str, pos: str, m: str, other: str) -> Column:
    """Length filter, and positional filter as it holds at the first shared shingle."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {100 + percent} * (1 + least({n} - {pos} - 1, {m} - {other} - 1)) >= {percent} * ({n} + {m})")


def _may_overlap(percent: int, n: str, parts: str, m: str, other: str) -> Column:
    """Suffix filter: the overlap is at most what the hash ranges' counts have in common."""
    return F.expr(f"{100 + percent} * aggregate(zip_with({parts}, {other}, (x, y) -> least(x, y)), 0L, (s, x) -> s + x) >= {percent} * ({n} + {m})")


class Join:
    def __init__(self, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> None:
        self.docs, self.n, self.percent, self.scratch = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, percent, scratch
        self.counts = cell_counts(self.docs, n)
        wide = scratch.save(signatures(self.docs, n, percent, self.counts))
        self.classes = scratch.save(wide.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts")))
        self.rows = scratch.save(wide.select("doc_id", "n", "d1", "d2"))
        scratch.drop(wide)
        self.links = self.done = None
        self.built: list[DataFrame] = []

    def components(self) -> DataFrame | None:
        """``node, component`` of the classes that link with another."""
        save, drop = self.scratch.save, self.scratch.drop
        rows = self._shared()
        labels, stars = None, ROUNDS
        while stars >= 0:
            if not stars:
                rows = self._postponed(rows, labels)
            labelled = self._labelled(rows, labels)
            found = self._verified(self._stars(labelled, stars) if stars else self._across(labelled))
            if stars:
                rows = rows.where("sets > 2")  # a star of two is their one pair
            drop(labelled)
            stars = stars - 1 if found is not None or not stars else 0  # stars that find nothing more leave the rest to the last round
            if found is None:
                continue
            self.links = found if self.links is None else save(self.links.unionByName(found))
            if labels is not None:
                drop(labels)
            labels = save(components(self.links, self.scratch))
        drop(*self.built)
        again = self._repeated()
        return labels if again is None else save(components(again if self.links is None else self.links.unionByName(again), self.scratch))

    def _repeated(self) -> DataFrame | None:
        """Edges that unite the classes of a doc_id which has several texts."""
        known = self.rows.where("n > 0 and doc_id is not null").select("doc_id", "d1", "d2").distinct()
        several = self.scratch.save(known.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
        if several.isEmpty():
            return None
        return known.join(several, "doc_id", "left_semi").join(self.classes.select("d1", "d2", "node"), ["d1", "d2"]).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    def _shared(self) -> DataFrame:
        """``token, node, n, pos, sets`` of the prefix shingles that several classes have."""
        posts = self.classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = posts.groupBy("token").agg(F.count("*").cast("int").alias("sets")).where("sets > 1")
        return self.scratch.save(posts.join(shared, "token").select("token", "node", F.col("n").cast("int").alias("n"), "pos", "sets"))

    def _component(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def _labelled(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """The rows with their component, of the shingles whose sets lie in several."""
        if labels is None:
            return self._component(rows, None)
        known = self._component(rows, labels)
        open_ = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
        return self.scratch.save(known.join(open_, "token"))

    def _postponed(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """``rows`` in one order, for all sets, that has the shingles of more than ``MANY`` components last."""
        save, last = self.scratch.save, None
        while True:
            lying = self._component(rows.where(f"sets > {MANY}"), labels).select("token", "component").distinct()
            many = lying.groupBy("token").agg(F.count("*").alias("k")).where(f"k > {MANY}").select("token")
            fresh = save(many if last is None else many.join(last, "token", "left_anti"))
            if fresh.isEmpty():
                return rows
            holders = save(rows.join(fresh, "token", "left_semi").select("node").distinct())
            every = self._sets(holders).join(holders, "node", "left_semi").select("node", F.explode("s").alias("token"))
            # all that as many of these sets have, wherever it stands in them: later prefixes would bring it up one part after the other
            common = every.groupBy("token").agg(F.count("*").alias("k")).where(f"k > {MANY}").select("token")
            known = fresh if last is None else last.unionByName(fresh)
            last = save(known.unionByName(common).distinct())
            # Every set whose prefix holds any of ``last``, shared or not, takes the new order. What no prefix holds changes none.
            touched = save(self.classes.select("node", F.explode("prefix").alias("token")).join(last, "token", "left_semi").select("node").distinct())
            sets = self._sets(touched).join(touched, "node", "left_semi")
            found = sets.select("node", F.explode("s").alias("token")).join(last, "token").groupBy("node").agg(F.collect_list("token").alias("last"))  # no longer than the set
            chosen = save(self._chosen(sets.join(found, "node")))
            self.classes = save(self.classes.join(chosen, ["d1", "d2"], "left").withColumn("prefix", F.coalesce("first", "prefix")).drop("first"))
            rows = self._shared()

    def _chosen(self, sets: DataFrame) -> DataFrame:
        """``d1, d2`` of ``sets`` (``s, last``) with their prefix, ``first``."""
        shared, percent = self.docs.sparkSession.sparkContext.broadcast(self.counts), self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                digests, firsts = [], []
                for s, last in zip(*b.columns, strict=True):
                    x, last = (np.array(v.as_py(), np.int64).view(np.uint64) for v in (s, last))
                    digests.append(digest(x))
                    firsts.append(prefix(x, percent, shared.value, last).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)), _lists(firsts, pa.int64())], ["d1", "d2", "first"])

        return sets.select("s", "last").mapInArrow(run, "d1 long, d2 long, first array<long>")

    def _stars(self, rows: DataFrame, number: int) -> DataFrame:
        me = F.struct("node", "n", "pos", "component")
        # Few rare shingles before a shared one mean few edits: such sets are near many others. Chance varies the choice by round.
        chance = lambda k: (F.pmod(F.xxhash64(F.lit(number * CENTERS + k), "node"), F.lit(1 << 20)) + (1 << 20)) * (F.col("pos") + 1)
        centers = rows.groupBy("token").agg(*[F.min_by(me, F.struct(chance(k), "node")).alias(f"c{k}") for k in range(CENTERS)])
        each = rows.join(centers, "token").select("*", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTERS)]))).alias("c"))
        near = each.where("component <> c.component").where(_passes(self.percent, "n", "pos", "c.n", "c.pos"))
        return near.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))

    def _across(self, rows: DataFrame) -> DataFrame:
        """All pairs across components: each set outside its shingle's largest component with every set of another one."""
        sizes = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
        largest = sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
        rows = self.scratch.save(rows.join(self.classes.select("node", "parts"), "node"))
        minor = rows.join(largest, "token").where("component <> largest").select("token", *[F.col(c).alias(f"m_{c}") for c in ("node", "n", "pos", "component", "parts")])
        near = (F.col("m_component") != F.col("component")) & _passes(self.percent, "n", "pos", "m_n", "m_pos") & _may_overlap(self.percent, "n", "parts", "m_n", "m_parts")
        met = minor.join(rows, (minor["token"] == rows["token"]) & near)
        return met.select(F.least("node", "m_node").alias("a"), F.greatest("node", "m_node").alias("b"))

    def _verified(self, pairs: DataFrame) -> DataFrame | None:
        """Those of ``pairs`` that link; None if no new one does. Suffix filter first, then the sets themselves, once a pair."""
        save = self.scratch.save
        pairs = pairs.distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["a", "b"], "left_anti")
        side = lambda x: self.classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"p{x}"))
        new = save(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_overlap(self.percent, "na", "pa", "nb", "pb")).select("a", "b").distinct())
        if new.isEmpty():
            return None
        self.done = new if self.done is None else save(self.done.unionByName(new))
        sets = self._sets(new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct())
        one, two = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        counted = new.join(one, "a").join(two, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
        links = save(counted.where(f"100L * i >= {self.percent} * (na + nb - i)").select("a", "b").distinct())
        return None if links.isEmpty() else links

    def _sets(self, nodes: DataFrame) -> DataFrame:
        """``node, s``: the sets of these documents and of others; each is built once and kept."""
        if self.built:
            nodes = nodes.join(self._kept().select("node"), "node", "left_anti")
        self.built.append(self.scratch.save(self._made(self.scratch.save(nodes))))
        return self._kept()

    def _kept(self) -> DataFrame:
        out = self.built[0]
        for df in self.built[1:]:
            out = out.unionByName(df)
        return out

    def _made(self, nodes: DataFrame) -> DataFrame:
        """The sets of some documents. A filter of fixed size on hash cells keeps most other texts from the join's shuffle."""
        cell = F.pmod(F.xxhash64("doc_id"), F.lit(NODE_CELLS))
        wanted = nodes.select(F.pmod(F.xxhash64("node"), F.lit(NODE_CELLS)).alias("cell")).distinct()
        texts = self.docs.join(F.broadcast(wanted), cell == F.col("cell"), "left_semi").join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t.as_py(), n, hashes).view(np.int64) for t in b.column(1)], pa.int64())], ["node", "s"])

        return texts.select("doc_id", "text").mapInArrow(run, "node long, s array<long>")


def joined(docs: DataFrame, n: int = 3, percent: int = 90, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    join = Join(docs, n, percent, scratch or Scratch(docs.sparkSession))
    labels = join.components()
    nodes = join.classes.select("d1", "d2", "node")
    known = nodes.withColumn("component", F.col("node")) if labels is None else nodes.join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    rows = join.rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1"), "d2")
    found = rows.join(known, ["d1", "d2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the least of their component, with their columns as they are.

    Rows of one doc_id and one text are one document: the first alone stays. Rows without a doc_id link with nothing and stay.
    """
    scratch = Scratch(docs.sparkSession)
    key = f"key_{uuid.uuid4().hex}"
    found = joined(docs, n, percent, scratch).where("doc_id is not null")
    counted = scratch.save(found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("k")).where("gone or k > 1").select(F.col("doc_id").alias(key), "gone"))
    left = docs.join(counted.where("gone").select(key), F.col("doc_id") == F.col(key), "left_anti")
    again = counted.where("not gone").select(key)
    if again.isEmpty():
        return left
    return left.join(again, F.col("doc_id") == F.col(key), "left_anti").unionByName(left.join(again, F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id", "text"]))
