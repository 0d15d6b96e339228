"""Byte-level BPE in two tiers, encoding and decoding.

Tier one: a minimal perfect hash (hash and displace) over the vocabulary resolves pre-tokens that
are entries themselves. Tier two: the others are merged by rank with a heap over a linked list of
byte spans, O(n log n) in the pre-token's length, so a text without blanks is no special case.
Ids equal those of the tiktoken library with the same ranks and pattern, special tokens off.

The tables are built once in each Python worker from the rank file (their size is the
vocabulary's); pre-tokens seen before come from a dictionary that is emptied when it reaches
``CACHE`` entries, which bounds memory whatever the corpus. No shuffle: one pass over the texts.
Null and empty texts have no ids. Rows are independent, so ties and repeats need no care.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 300_000


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings onto their ids.

    Keys fall into buckets; each bucket, the largest first, takes the first displacement that sends
    its keys to free slots. ``get`` compares the key found, so other strings give None.
    """

    def __init__(self, entries: dict[bytes, int], load: int = 4) -> None:
        n = max(1, len(entries))
        self.n, self.buckets = n, n // load + 1
        hashed = [(xxhash.xxh3_64_intdigest(k), k, v) for k, v in entries.items()]
        groups: list[list] = [[] for _ in range(self.buckets)]
        for x in hashed:
            groups[x[0] % self.buckets].append(x)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.ids = [0] * n
        taken = bytearray(n)
        free = iter(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # any free slot does; its displacement is stored as the slot, negated
                slot = next(i for i in free if not taken[i])
                self.shift[b], slots = -slot - 1, [slot]
            else:
                d = 0
                while len(set(slots := [self._slot(h, d) for h, _, _ in group])) < len(slots) or any(taken[s] for s in slots):
                    d += 1
                self.shift[b] = d
            for s, (_, k, v) in zip(slots, group, strict=True):
                taken[s], self.keys[s], self.ids[s] = 1, k, v

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 32) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else None


def merged(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of least rank merges first, the leftmost of equals."""
    n = len(token)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the span that starts at i: its end, the start before
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(token[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        r, i, e = heappop(heap)
        j = end[i]
        if j >= n or j <= i or end[j] != e:  # a span of this pair has gone
            continue
        end[i], end[j] = e, -1
        if e < n:
            before[e] = i
            if (r := get(token[i : end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := get(token[p:e])) is not None:
            heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Codec(dict):
    """Pre-token to the packed ids (little-endian, 32 bits each)."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.whole, self.pattern = PerfectHash(self.ranks), regex.compile(pattern)
        self.bytes_of = {i: k for k, i in self.ranks.items()}

    def __missing__(self, word: str) -> bytes:
        key = word.encode()
        found = self.whole.get(key)
        ids = [found] if found is not None else merged(key, self.ranks)
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (binary: little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([made.encode(t or "") for t in _each(b.column(1))], pa.binary())], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids binary")


def decoded(ids: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key``, ``ids``, ``bytes``: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([made.decode(x) for x in _each(b.column(1))], pa.binary())], [key, "ids", "bytes"])

    return ids.select(key, "ids").mapInArrow(run, f"{key} {ids.schema[key].dataType.simpleString()}, ids binary, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids and digests both, in one pass without keeping them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for b in batches:
            counts, ids, back = [], [], []
            for t in _each(b.column(1)):
                packed = made.encode(t or "")
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(made.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _each(column: pa.Array) -> Iterator:
    """Values one at a time, so that a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)
