"""The n-gram join against all pairs."""

from __future__ import annotations

import random

import pytest

from callweave.llm import ngram_join
from callweave.llm.common import Scratch
from callweave.llm.components import components


def brute(rows: list[tuple[int | None, str | None]], n: int, percent: int) -> dict:
    """All pairs, plain sets, union-find."""
    sets = {}
    for key, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        own = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
        sets.setdefault(key, []).append(own)
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(k for k in sets if k is not None)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                up[max(ra, rb)] = min(ra, rb)
    return {k: find(k) if k is not None else None for k in sets}


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3), (2, 100, 4)])
def test_components_equal_all_pairs(spark, n, percent, seed):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 120))] for _ in range(12)]
    shared = [f"s{i}" for i in range(40)]  # a passage that unrelated texts have
    texts: list[str | None] = [None, "", " \n", "one", "ONE", "one two", "Two one", "É é", "é é"]
    for b in bases:
        texts += [" ".join(edited(rng, b, rng.choice([0, 0, 0.01, 0.02, 0.05, 0.1]))) for _ in range(rng.randint(1, 14))]
        texts.append(" ".join(shared + b[: rng.randint(0, 10)]))
    texts += [" ".join(edited(rng, bases[0], rng.choice([0.01, 0.03]))) for _ in range(60)]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, texts[5])]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, node string")
    found = ngram_join.joined(docs, n, percent).collect()
    assert len(found) == len(rows)
    want = brute(rows, n, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_last_round_alone_is_exact(spark, monkeypatch):
    """Without star rounds every link comes from the last round."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(40)]
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 3, 90)


@pytest.mark.parametrize(("many", "rounds"), [(1, 2), (3, 0)])
def test_postponed_shingles_keep_the_result(spark, monkeypatch, many, rounds):
    """With common shingles put last in the order all links are found, by whatever rounds."""
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = random.Random(many)
    passage = [f"s{i}" for i in range(30)]
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 8, 40]))] for _ in range(14)]
    texts = [" ".join([*passage, *edited(rng, b, 0.02)]) for b in bases for _ in range(3)] + [" ".join(passage), " ".join([*passage, "x"])]
    rows = [*enumerate(texts), (2, texts[40]), (7, "a b c d")]  # a doc_id of two texts
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 3, 80)


def test_keep_repeats_clashes_and_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "A b c d e f", 1), (None, "a b c d e f", 2), (None, "a b c d e f", 2), (3, long, 3), (4, long + " w", 4), (5, "", 5), (5, "", 5)]
    docs = spark.createDataFrame([(*r, *r[:1] * 4) for r in rows], "doc_id long, text string, k int, __doc_id long, node long, component_id long, n long")
    out = ngram_join.keep(docs)
    assert out.columns == docs.columns
    assert sorted((repr(r["doc_id"]), r["k"]) for r in out.collect()) == [("1", 0), ("3", 3), ("5", 5), ("None", 2), ("None", 2)]


def test_keep_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long, "en", "a", 1), (3, long, "en", "b", 1), (9, long + " tail", "en", "a", 1), (4, "all else here is different", "de", "a", 1), (7, None, None, None, None), (8, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = ngram_join.keep(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 4, 7, 8]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.joined(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (7, 7), (None, 3), (3, None)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    up: dict[int, int] = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {k: find(k) for k in up}


def two_orders() -> list[str]:
    """Two linked texts whose common words are put last because of other texts' prefixes."""
    t, fresh = [f"t{i}" for i in range(1, 18)], [f"f{i}" for i in range(250)]
    own = iter(range(10**6))
    new = lambda k: [f"o{next(own)}" for _ in range(k)]
    texts = [["x", "c", "d", *t], ["f", "c", "d", *t]]
    texts += [[*new(2), "f", "c", "d", *(f"g{i}" for i in range(1, 16))] for _ in range(30)]
    texts += [[c, *new(19)] for c in "cd" for _ in range(15)]
    texts += [[*t, *(f"g{i}" for i in range(1, 16)), *new(5), *fresh] for _ in range(100)]
    return [" ".join(x) for x in texts]


@pytest.mark.parametrize("many", [1, 20, 10_000])
def test_one_order_for_all_sets(spark, monkeypatch, many):
    monkeypatch.setattr(ngram_join, "MANY", many)
    rows = list(enumerate(two_orders()))
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 1, 90)
    assert {r["component_id"] for r in found if r["doc_id"] < 2} == {0}


@pytest.mark.parametrize(("many", "rounds", "seed"), [(1, 1, 1), (2, 2, 2), (5, 1, 3), (9, 2, 4), (20, 0, 5)])
def test_postponed_shingles_of_random_texts(spark, monkeypatch, many, rounds, seed):
    """Words of very different frequencies, so that several rounds put some last."""
    monkeypatch.setattr(ngram_join, "MANY", many)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = random.Random(seed)
    zipf = lambda k: [f"z{int(40 * rng.random() ** 3)}" for _ in range(k)]
    bases = [zipf(rng.randint(8, 30)) + [f"b{i}_{j}" for j in range(rng.randint(0, 12))] for i in range(25)]
    rows = list(enumerate(" ".join(edited(rng, b, rng.choice([0, 0.03, 0.08]))) for b in bases for _ in range(5)))
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows, 1, 80)
