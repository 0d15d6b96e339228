"""Registered graph and order queries against their SQL; components, rings, many seeds and preorder against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import cycles, graph
from callweave.operators.resolve import preorder
from callweave.oracles import ORACLE_SQL
from callweave.plans.scratch import Scratch
from callweave.queries import QUERIES


def closure(pairs, nodes):
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    while True:
        more = {n: r | {x for m in r for x in reach[m]} for n, r in reach.items()}
        if more == reach:
            return reach
        reach = more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(rng.choice([25, 40, 60]))} | {(100 + i, 101 + i) for i in range(9)} | {(109, 100)}
    reach = closure({p for p in pairs if p[0] != p[1]}, {x for p in pairs for x in p})
    want = {n: min(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if n in reach[n]}
    got = cycles.strong_components(spark.createDataFrame([*pairs, *list(pairs)[:3]], "src long, dst long")).collect()
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)
    assert all(r["size"] == sum(c == r["component"] for c in want.values()) for r in got)


def test_components_and_rings_of_empty_graphs(spark):
    for rows in ([], [(1, 1)], [(1, 2), (2, 3)]):
        links = spark.createDataFrame(rows, "src long, dst long")
        assert cycles.strong_components(links).count() == 0 and cycles.rings(links).count() == 0


def brute_levels(pairs, seeds, depth):
    out = {}
    for seed, starts in seeds.items():
        seen = {s: 0 for s in starts}
        now = set(starts)
        for d in range(1, depth + 1):
            now = {a for a, b in pairs if b in now and a != b} - set(seen)
            seen.update(dict.fromkeys(now, d))
        out[seed] = {k: d for k, d in seen.items() if d}
    return out


def test_bits_of_many_seeds(spark):
    """More seeds than bits, some of several ids, some that nothing reaches."""
    rng = random.Random(4)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(150)]
    edges = spark.createDataFrame(pairs + pairs[:9], "from_symbol_id long, to_symbol_id long")
    starts = {s: [s] for s in range(150)} | {500: [1, 2, 3]}
    seeds = spark.createDataFrame([(s, i) for s, ids in starts.items() for i in ids], "seed long, id long")
    number, hits = graph.reached_bits(edges, seeds)
    got = graph._each_bit(hits).join(number, ["block", "bit"]).select("seed", "id", "depth").collect()
    want = brute_levels(pairs, starts, 4)
    assert len(got) == sum(map(len, want.values())) and all(want[r["seed"]][r["id"]] == r["depth"] for r in got)
    plain = {(r["seed"], r["id"], r["depth"]) for r in graph.reached(edges, seeds).collect()}
    assert plain == {(r["seed"], r["id"], r["depth"]) for r in got}


def test_preorder_of_random_graphs(spark):
    rng = random.Random(6)
    up = {}
    for g in range(40):
        for i in range(7):
            later = [j for j in range(i + 1, 7) if rng.random() < 0.45]
            rng.shuffle(later)
            up[f"{g}.{i}"] = [f"{g}.{j}" for j in later]
    up |= {"x": ["y", "z"], "y": ["z", "x"], "z": ["y"]}  # cycles end

    def walk(t, seen):
        if t in seen:
            return []
        seen.add(t)
        return [t, *(a for p in up[t] for a in walk(p, seen))]

    parents = spark.createDataFrame([(t, p, i) for t, ps in up.items() for i, p in enumerate(ps)], "fqn string, parent string, at int")
    got = {}
    for r in preorder(spark.createDataFrame([(t,) for t in up], "fqn string"), parents, Scratch(spark)).orderBy("fqn", "path").collect():
        got.setdefault(r["fqn"], []).append(r["ancestor"])
    assert got == {t: walk(t, set()) for t in up}


@pytest.mark.parametrize("name", ["g2_impact", "g8_module_rings", "g8_strong_components", "r2_ancestor_order", "r4_diamond_calls", "j8_unreached", "a14_candidate_tests", "g9_dead_code", "g9_held_back"])
def test_sql_agrees_and_has_rows(spark, same, name):
    same(QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_rings_have_long_ones(spark):
    made = QUERIES["g8_module_rings"](spark, "/root/testdata/sf0.01")
    lengths = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    assert lengths[7] > 2
