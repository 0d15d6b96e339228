"""Periodic runs: maximal repetitions of words with four periods or more, by divide and conquer after Main and Lorentz.

A text's words are interned as whole numbers. It is halved again and again; a run lies across the middle of exactly one
of the resulting segments that hold it whole. For each period q up to a quarter of a segment, a run across its middle m
holds the pair (m, m + q) or (m - q, m); how far equality reaches from that pair to either side gives the run. All middles
of one depth, of many texts at once, are looked at together:

1. For each middle and period the pair itself is compared, then the reach to either side up to ``NEAR`` words. In prose
   nearly nothing is left after this.
2. Where ``NEAR`` words don't decide, the segment's Z-functions do: of its right half (what follows m against m + q), of its left half
   reversed (what precedes m against m - q), and of either half followed by the other side of the middle. They are linear in the segment.
3. A stretch that could be extended beyond its segment is left out, as a segment above finds it whole. The intervals are deduplicated and keep
   their smallest period: by the periodicity lemma, all periods of which an interval holds four share it.

Time is n log n for any text; memory is that of a batch of ``BATCH`` words, or of the longest text. Each row is read on its
own: no shuffle.

Words are runs of characters other than blank and the control characters 9 to 13, compared byte by byte. Null, empty and
blank texts have no words, no runs and an empty collapsed text. Repeated rows and null ids are rows like others. Other columns,
whatever their names, play no part. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has ``LEAST`` words and ``POWER`` periods at least.
LEAST, POWER = 6, 4
NEAR, BATCH = 16, 200_000
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_function(x: list[int]) -> np.ndarray:
    """How many elements from each place on equal the first ones of ``x``."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def _reach(w: np.ndarray, x: np.ndarray, q: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """For how many places, up to ``NEAR``, w is equal at x and x + q, going by ``step`` and not over ``edge``."""
    out = np.zeros(len(x), np.int64)
    live, a, b = np.arange(len(x)), x.copy(), x + q
    for _ in range(NEAR):
        inside = (b < edge[live]) if step > 0 else (a >= edge[live])
        live, a, b = live[inside], a[inside], b[inside]
        equal = w[a] == w[b]
        live, a, b = live[equal], a[equal], b[equal]
        if not len(live):
            break
        out[live] += 1
        a += step
        b += step
    return out


def _enough(length: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (length >= POWER * q) & (length >= LEAST)


def _by_z(w: np.ndarray, lo: int, m: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and period of what crosses m in w[lo:hi], from the segment's Z-functions."""
    top = (hi - lo) // POWER
    q = np.arange(1, top + 1)
    right, left = w[m:hi].tolist(), w[lo:m][::-1].tolist()
    ahead = z_function(right)  # w[m:] against w[m + q:]
    back = z_function(left)  # before m against before m - q
    after = z_function([*left, -1, *w[lo : m + top][::-1].tolist()])[len(left) + 1 :]  # before m against before m + q
    behind = z_function([*right, -1, *w[m - top : hi].tolist()])[len(right) + 1 :]  # w[m:] against w[m - q:]
    yield m - after[top - q], m + q + ahead[q], q
    yield m - q - back[q], m + np.minimum(behind[top - q], len(right)), q


def repetitions(w: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of the texts whose words are ``w[bounds[i]:bounds[i + 1]]``, by start, then period."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    los, his = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    first = np.zeros(len(w) + 1, bool)
    first[bounds] = True  # where a text starts or ends
    while True:
        wide = his - los >= LEAST
        los, his = los[wide], his[wide]
        if not len(los):
            break
        ms, tops = (los + his) // 2, (his - los) // POWER
        at = np.repeat(np.arange(len(los)), tops)
        q = np.arange(len(at)) - np.repeat(np.cumsum(tops) - tops, tops) + 1
        hard = np.zeros(len(los), bool)
        parts = []
        for shift in (0, 1):
            x = ms[at] - shift * q
            equal = w[x] == w[x + q]
            s, p, x = at[equal], q[equal], x[equal]
            onward, backward = _reach(w, x, p, his[s], 1), _reach(w, x - 1, p, los[s], -1)
            far = (onward == NEAR) | (backward == NEAR)
            hard[s[far]] = True
            fits = ~far & _enough(onward + backward + p, p)
            parts.append((s[fits], (x - backward)[fits], (x + p + onward)[fits], p[fits]))
        easy = [tuple(v[~hard[s]] for v in rest) for s, *rest in parts]
        for k in np.flatnonzero(hard).tolist():
            easy += _by_z(w, int(los[k]), int(ms[k]), int(his[k]))
        for start, end, p in easy:
            fits = _enough(end - start, p)
            start, end, p = start[fits], end[fits], p[fits]
            # what goes on over the segment's edge is whole in a segment above
            before, behind = np.maximum(start - 1, 0), np.minimum(end, len(w) - 1)
            whole = (first[start] | (w[before] != w[before + p])) & (first[end] | (w[behind] != w[behind - p]))
            found.append((start[whole], end[whole], p[whole]))
        los, his = np.concatenate((los, ms)), np.concatenate((ms, his))
    if not found:
        return (np.array([], np.int64),) * 3
    start, end, p = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _batch(texts: list[list[bytes]]) -> list[tuple[list[dict], bytes]]:
    """The runs of each text and its collapsed words, joined by one space."""
    ids: dict[bytes, int] = {}
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    w = np.fromiter((ids.setdefault(x, len(ids)) for t in texts for x in t), np.int32, int(bounds[-1]))
    start, end, period = repetitions(w, bounds)
    # a word is dropped if it lies in a run after the run's first period
    depth = np.zeros(len(w) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    kept = np.cumsum(depth)[:-1] == 0
    of = np.searchsorted(bounds, start, "right") - 1  # empty texts hold no run: the last one that starts there has it
    firsts = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for k, words in enumerate(texts):
        lo, hi, base = firsts[k], firsts[k + 1], bounds[k]
        if lo == hi:
            out.append(([], b" ".join(words)))
            continue
        runs = [{"start": s, "length": n, "period": p} for s, n, p in zip((start[lo:hi] - base).tolist(), (end[lo:hi] - start[lo:hi]).tolist(), period[lo:hi].tolist(), strict=True)]
        out.append((runs, b" ".join([x for x, keep in zip(words, kept[base : bounds[k + 1]].tolist(), strict=True) if keep])))
    return out


def detected(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs`` (by start, then period) and ``collapsed``, the text's words without what repeats a run's first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            got = _batch(texts)
            columns = [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([r for r, _ in got], pa.list_(RUN)), pa.array([c.decode() for _, c in got], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

        keys: list[int | None] = []
        texts: list[list[bytes]] = []
        size = 0
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                keys.append(key.as_py())
                texts.append((text.as_py() or "").encode().split())  # of bytes: ASCII white space alone
                size += len(texts[-1])
                if size >= BATCH or len(texts) >= 10_000:
                    yield done()
                    keys, texts, size = [], [], 0
        if texts:
            yield done()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)
