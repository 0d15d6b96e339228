"""Concatenate and cut, periodic runs, embedding whitening: against restatements of their contracts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callweave.llm import concat_packing, runs, whitening
from callweave.llm.common import Scratch
from callweave.llm.queries import QUERIES, tokenizer_files, with_periods

SMALL = "/root/testdata/sf0.001"


# concatenate and cut


def _check_pieces(pieces, expected, length):
    """Each id in exactly one piece, sequences gapless and full but for the last, checksums right."""
    by_row: dict = {}
    for r in pieces:
        by_row.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (key, total), own in by_row.items():
        copies = [ids for k, ids in expected if k == key and len(ids) == total]
        own.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        assert sum(r["length"] for r in own) == sum(map(len, copies))
        if len(copies) == 1:
            own.sort(key=lambda r: r["start"])
            assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
            assert all(r["ids_crc32"] == zlib.crc32(np.array(copies[0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
            assert [r["from_previous"] for r in own] == [False, *[True] * (len(own) - 1)] and [r["into_next"] for r in own] == [*[True] * (len(own) - 1), False]
    assert sum(r["length"] for r in pieces) == sum(len(ids) for _, ids in expected)
    sequences: dict = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fills = []
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        fills.append(at)
    assert sorted(fills)[1:] == [length] * (len(fills) - 1) and max(fills, default=0) <= length


def test_windows_hold_every_id_once(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = [None, "", "same", "same", "word " * 9000, *(" ".join(rng.choice("alpha beta gamma δ 漢".split()) for _ in range(rng.randint(0, 400))) for _ in range(60))]
    rows = [(i if i != 7 else None, t, "x", 5) for i, t in enumerate(texts)] + [(1, "", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(5)
    expected = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t, *_ in rows]
    for length in (2048, 7):
        _check_pieces(concat_packing.packed(docs, tokenizer_files(), length).collect(), expected, length)
    assert concat_packing.packed(docs.limit(0), tokenizer_files()).count() == 0
    joined = concat_packing.BROADCAST
    try:
        concat_packing.BROADCAST = 0  # bases joined, not broadcast
        _check_pieces(concat_packing.packed(docs, tokenizer_files(), 100).collect(), expected, 100)
    finally:
        concat_packing.BROADCAST = joined


def test_bases_by_blocks(spark):
    sizes = [(p, (p * 37) % 11 + 1) for p in range(0, 200, 3)]
    got = dict(concat_packing.bases(spark.createDataFrame(sizes, "part int, size long"), Scratch(spark), block=8).collect())
    assert got == {p: sum(s for o, s in sizes if o < p) for p, _ in sizes}


def test_padding_of_windows(spark):
    pieces = concat_packing.packed(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), tokenizer_files(), 4)
    got = {r["sequence_id"]: (r["tokens"], r["padding"]) for r in concat_packing.windows(pieces, 4).collect()}
    last = max(got)
    assert all(v == (4, 0) for k, v in got.items() if k != last) and got[last][1] in (0, 4 - got[last][0])


# runs


def brute_runs(words):
    """Every maximal repetition with enough periods, smallest period first."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def own_runs(texts):
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    start, end, q = runs.repetitions(np.array([x for t in texts for x in t], np.int32), bounds)
    out = [[] for _ in texts]
    for s, e, p in zip(start.tolist(), end.tolist(), q.tolist(), strict=True):
        k = max(i for i in range(len(texts)) if bounds[i] <= s and len(texts[i]))
        out[k].append((s - int(bounds[k]), e - s, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


WORDS = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 3), max_size=12)).map(lambda t: t[0] * t[1] + t[2] + t[0] * t[1]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=4))
def test_runs_equal_brute_force(texts):
    assert own_runs(texts) == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_runs_of_long_periods_and_powers():
    rng = random.Random(1)
    base = [rng.randrange(50) for _ in range(90)]
    texts = [base * 5 + [99] + base * 4, [0] * 400, [0, 1] * 300 + [0] * 100, [rng.randrange(400) for _ in range(3000)] + base * 7, ([0] * 20 + [1]) * 12 + [0] * 20]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    texts.append(fib[-1] + fib[-1][:50] * 6)
    assert own_runs(texts) == [sorted(brute_runs(t), key=lambda r: (r[0], r[2])) for t in texts]


def test_runs_far_reach_needs_no_square():
    texts = [[0] * 300_000, list(range(1000)) * 40]
    got = own_runs(texts)
    assert got == [[(0, 300_000, 1)], [(0, 40_000, 1000)]]


@given(st.lists(st.integers(0, 1), max_size=40))
@settings(max_examples=200, deadline=None)
def test_z_function(x):
    n = len(x)
    want = [next((k for k in range(n - i) if x[k] != x[i + k]), n - i) for i in range(n)]
    assert runs.z_function(x).tolist() == want


def restated(doc_id, text):
    """op12's row by the letter of its contract."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op12_equals_the_contract(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    want = {restated(r["doc_id"], r["text"]) for r in docs}
    assert got == want and sum(r[1] > 0 for r in want) > 5


def test_runs_of_odd_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "la la la la la la la", "x y " * 6 + "z", "é\x1cé b " * 7, "a " * 50_000, "a b a b a b a b c " * 5]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, texts[4], "r", 1), (4, texts[4], "r", 1)]
    rows += [(k, f"w{k} " + "p q r s t " * 9, "r", 1) for k in range(40, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, h int")
    plain = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.detected(docs).collect() if r["doc_id"] in (0, 1, 2, 3, 4, 5)), key=repr)
    assert plain[0] == (0, [], "") and plain[3] == (3, [], "a") and plain[4] == plain[5] == (4, [(0, 7, 1)], "la")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    short = [r for r in rows if r[1] is None or len(r[1]) < 50_000]
    assert [g for g in got if g[0] != 7] == sorted((restated(r[0], r[1]) for r in short), key=repr)
    assert with_periods(docs).where("doc_id is null").first()["text"] == texts[4]
    assert runs.detected(docs.limit(0)).count() == 0


# whitening


def _check_whitened(rows, vectors, tolerance=1e-9):
    """Against a dense eigendecomposition of the fit list's covariance."""
    good = [(k, v) for k, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: tuple(int(np.floor(256 * float(c))) for c in v) for k, v in good}
    fit = np.array(sorted(set(x.values())), float)
    n, sums = len(fit), [sum(int(v) for v in col) for col in fit.T]
    mean = np.array(sums) / n
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, axes = values[::-1], axes[:, ::-1]
    signs = {}
    assert len(rows) == len(good) * min(4, len(mean))
    for r in rows:
        k, own = r["component"] - 1, x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(own, sums, strict=True))
        want = float((np.array(own) - mean) @ axes[:, k] / np.sqrt(values[k]))
        sign = signs.setdefault(k, 1 if want * r["whitened"] >= 0 else -1) if abs(want) > 1e-3 else signs.get(k, 1)
        assert abs(want - sign * r["whitened"]) < tolerance * max(1, abs(want)) or abs(want) <= 1e-3
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9 and r["residual"] < 1e-9 * r["eigenvalue"] * 1e3


def test_op13_equals_eigh(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    _check_whitened(QUERIES["op13_embedding_whitening"](spark, SMALL).collect(), vectors)


@pytest.mark.parametrize("d", [1, 3, 70])
def test_whitening_sizes(spark, d):
    rng = np.random.default_rng(d)
    points = rng.standard_normal((300, d)) @ np.diag(np.linspace(3, 0.5, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    vectors = [(i, v.tolist()) for i, v in enumerate(points)] + [(1000 + i, points[0].tolist()) for i in range(50)]
    bad = [(2000, None), (2001, [None] + [0.0] * (d - 1)), (2002, [float("nan")] * d), (2003, [float("-inf")] * d), (2004, [0.5] * (d + 1)), (2005, [])]
    table = spark.createDataFrame([(k, v, "t", 1) for k, v in vectors + bad], "vec_id long, embedding array<double>, x string, d int")
    _check_whitened(whitening.whitened(table).collect(), vectors)


def test_lobpcg_with_close_values_and_small_blocks():
    rng = np.random.default_rng(5)
    values = np.concatenate(([9.0, 8.999, 8.5, 8.499, 8.4], np.linspace(8, 0.1, 195)))
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    a = q @ np.diag(values) @ q.T
    got, axes, norms = whitening.lobpcg(lambda w: a @ w, 200, 4, 8)
    assert np.allclose(got, values[:4], rtol=1e-12) and norms.max() < 1e-10 and np.allclose(axes.T @ axes, np.eye(4), atol=1e-12)
    assert np.allclose(np.abs(axes.T @ q[:, :4]), np.eye(4), atol=1e-8)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)] + [(None, [1.0, 2.0, 1.0])], schema))
    assert line.select(F.max("component"), F.count("*")).first() == (1, 10)


def test_whitening_beyond_64_bits(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e15, 3.0])]
    got = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    assert len(got) and all(r["deviation"] is None for r in got)
