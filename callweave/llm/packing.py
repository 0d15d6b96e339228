"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Every whole text is tokenised once; only its pieces' lengths and checksums go on. A document
longer than a sequence is cut into full pieces with the remainder first. Full pieces are
sequences of their own. The others are dealt into groups of about ``GROUP`` pieces by a
hash of a row number, so that no document, source or length can make a group large; each group
runs best-fit decreasing and computes lower bounds from dual feasible functions: the
identity, those that round items above half (for every threshold), and the rounding functions of
k parts. A group whose number of bins meets the bound is certified: no packing of its
pieces is better. Groups with a gap give up the bins that aren't full; these pieces are exchanged
between the groups (dealt anew by another hash) and packed again, for as long as that saves
bins. The last, least filled bins of certified groups join the
exchange, so groups cost no bins of their own.

Token ids equal those of the tokenizers library for the given vocabulary, specials in the text
included; they come from the same merges in tiktoken's core, which takes a fifth of the time. That core's pattern
engine gives up on very long runs of white space, so these are cut out by the pattern's own rule and encoded whole
(``Ids``): texts of any length and kind are encoded.

Null text is an empty document (its end token alone). Null ids and repeated rows are pieces like others:
each row is packed. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch

LENGTH, END, GROUP = 1024, 2, 32_768
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class Ids:
    """Text to ids as an array, specials in the text as their own ids, as the tokenizers library has it.

    A run of white space is one pre-token up to its last character; that one goes with what follows, unless the text or
    a special token ends the run. Nothing else in the pattern reaches over a run's start.
    """

    #: Shorter runs are left to the pattern engine.
    RUN = regex.compile(r"\p{White_Space}{50000,}")

    def __init__(self, ranks: str, vocabulary: str, pattern: str) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        with open(vocabulary, encoding="utf-8") as f:
            specials = {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["special"]}
        self.specials, self.core = specials, tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=merges, special_tokens=specials)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) < 50_000 or not self.RUN.search(text):
            return self._short(text)
        out, done = [], 0
        for m in self.RUN.finditer(text):
            end = m.end() if m.end() == len(text) or text.startswith(tuple(self.specials), m.end()) else m.end() - 1
            out += [self._short(text[done : m.start()]), np.array(self.core._encode_single_piece(text[m.start() : end]), np.uint32)]
            done = end
        return np.concatenate((*out, self._short(text[done:])))

    def _short(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all", disallowed_special=())


@cache
def tokenizer(ranks: str, vocabulary: str, pattern: str) -> Ids:
    return Ids(ranks, vocabulary, pattern)


def cuts(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else the remainder first and full ones after it."""
    first = total % length or length
    return [(0, first), *((s, length) for s in range(first, total, length))]


def pieces(docs: DataFrame, tokenizer_args: tuple[str, str, str], length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece; ``row`` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = tokenizer(*tokenizer_args), TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), length)):
                    out.append((row, key.as_py(), k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing over ``lengths`` in descending order: each item's bin and offset, each bin's fill."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    mask = 0  # of the spaces that some bin has
    for i, n in enumerate(lengths.tolist()):
        fitting = mask >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask ^= 1 << space
        else:
            b, space = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if rest := space - n:
            free[rest].append(b)
            mask |= 1 << rest
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, parts: int = 32) -> int:
    """The largest of the bounds that dual feasible functions give; no packing has fewer bins.

    For each t up to half the capacity: items above capacity - t count as a whole bin, those below t as
    nothing, others as their share. For each k up to ``parts``: an item whose (k + 1)-fold is a
    multiple of the capacity counts as its share, others as floor((k + 1) x / capacity) / k.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(object if len(lengths) > 1 << 40 else np.int64)
    x = np.arange(capacity + 1)
    mass, number = np.concatenate(([0], np.cumsum(counts * x))), np.concatenate(([0], np.cumsum(counts)))
    t = np.arange(capacity // 2 + 1)
    top = capacity - t  # items above top count whole, items from t to top by their share
    shares = capacity * (number[-1] - number[top + 1]) + (mass[top + 1] - mass[t])
    best = int(-(-shares.max() // capacity))
    for k in range(1, parts + 1):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        # over the common denominator k * capacity
        value = int((counts * np.where(exact, k * x, capacity * (scaled // capacity))).sum())
        best = max(best, -(-value // (k * capacity)))
    return best


def _pack(capacity: int, shift: int):
    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("g")[0].as_py()
        rows = rows.drop_columns(["g"]).sort_by([("length", "descending"), ("row", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        if len(fill) == lower_bound(lengths, capacity):  # certified: only the emptiest bin may still be joined with other groups' ones
            given = np.zeros(len(fill), bool)
            given[int(fill.argmin())] = fill.min() < capacity
        else:
            given = fill < capacity
        sequences = (shift << 48) + (group << 20) + bins
        for name, values in (("sequence_id", pa.array(sequences, pa.int64())), ("offset", pa.array(offsets, pa.int64())), ("given", pa.array(given[bins]))):
            rows = rows.append_column(name, values)
        return rows

    return run


def _round(rows: DataFrame, n: int, capacity: int, number: int, scratch: Scratch) -> DataFrame:
    groups = max(1, -(-n // GROUP))
    dealt = rows.select(*[x.split()[0] for x in PIECES.split(", ")], F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)).alias("g"))
    return scratch.save(dealt.groupBy("g").applyInArrow(_pack(capacity, number), f"{PACKED}, given boolean"))


def packed(docs: DataFrame, tokenizer_args: tuple[str, str, str], length: int = LENGTH, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row."""
    scratch = Scratch(docs.sparkSession)
    every = scratch.save(pieces(docs, tokenizer_args, length, end))
    columns = [x.split()[0] for x in PACKED.split(", ")]
    done = [every.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")}).select(*columns)]
    rest = every.where(F.col("length") < length)
    n = rest.count()
    now = _round(rest, n, length, 0, scratch) if n else None
    number = 0
    while now is not None:
        number += 1
        before, n = now.where("given").agg(F.countDistinct("sequence_id"), F.count("*")).first()
        if before < 2:
            break
        given = now.where("given")
        after = _round(given, n, length, number, scratch)
        if after.select("sequence_id").distinct().count() >= before:
            break
        done.append(now.where("not given").select(*columns))
        now = after
    if now is not None:
        done.append(now.select(*columns))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.drop("row")
