"""Every registered query against its SQL, and what SQL leaves out: loops, caps, edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import cycles, graph, insight, relations, search
from callweave.oracles import ORACLE_SQL
from callweave.queries import QUERIES


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


EDGES = "from_symbol_id long, to_symbol_id long, kind string, confidence double, via string, line int"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", 1.0, "direct", 1) for a, b in pairs] or [], EDGES)


def test_self_loop_counts_once(spark):
    got = {r["id"]: r["degree"] for r in insight.degrees(edges_of(spark, [(1, 1), (1, 2), (2, 1)])).collect()}
    assert got == {1: 3, 2: 2}
    assert relations.neighbours(edges_of(spark, [(1, 1)])).count() == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(45)]
    callers: dict[int, set[int]] = {}
    for a, b in pairs:
        callers.setdefault(b, set()).add(a)
    want = set()
    for s in range(25):
        seen, frontier = {s}, {s}
        for depth in range(1, 4):
            frontier = {c for x in frontier for c in callers.get(x, ())} - seen
            want |= {(s, x, depth) for x in frontier}
            seen |= frontier
    seeds = spark.range(25).select(F.col("id").alias("seed"), "id")
    assert {tuple(r) for r in graph.reached(edges_of(spark, pairs), seeds, 3).select("seed", "id", "depth").collect()} == want


NO_STRUCTURE = "type_id long, member_id long"


def test_shortest_path(spark):
    edges = edges_of(spark, [(1, 2), (2, 3), (1, 4), (4, 5), (5, 3), (3, 9), (11, 12)])
    none = spark.createDataFrame([], NO_STRUCTURE)
    assert graph.path_between(edges, none, 1, 1) == []
    assert [h["id"] for h in graph.path_between(edges, none, 1, 9)] == [2, 3, 9]
    assert graph.path_between(edges, none, 9, 1) is None
    inside = spark.createDataFrame([(9, 11), (20, 12)], NO_STRUCTURE)
    assert [(h["id"], h["kind"]) for h in graph.path_between(edges, inside, 3, 20)] == [(9, "calls"), (11, "declares"), (12, "calls")]


def test_path_over_repositories(spark):
    a, b = edges_of(spark, [(1, 2), (2, 3)]), edges_of(spark, [(7, 8), (8, 9)])
    none = spark.createDataFrame([], NO_STRUCTURE)
    pairs = spark.createDataFrame([(3, 7), (2, 8), (5, 9)], "mine long, theirs long")
    assert graph.path_across(a, b, pairs, 1, 9, none) == 3
    assert graph.path_across(a, b, pairs.where("mine = 5"), 1, 9, none) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = "abcdefg"
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(16)})
    out: dict[str, list[str]] = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, []).append(b)
    want = set()

    def walk(path):
        for n in out.get(path[-1], []):
            if n == path[0] and min(path) == path[0]:
                want.add(tuple(path))
            elif n not in path and len(path) < 7:
                walk([*path, n])

    for n in names:
        walk([n])
    got = cycles.rings(spark.createDataFrame(pairs, "src string, dst string"), 6)
    rows = [tuple(r["ring"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_around_is_capped_and_has_no_loose_edges(spark):
    edges = edges_of(spark, [(1, i) for i in range(2, 30)] + [(2, 3), (40, 41)])
    none = spark.createDataFrame([], NO_STRUCTURE)
    nodes, kept, truncated = graph.around(edges, none, spark.range(1, 2), 1, 10)
    ids = {r["id"] for r in nodes.collect()}
    assert len(ids) == 10 and truncated and ids == set(range(1, 11))
    assert {(r[0], r[1]) for r in kept.select("from_symbol_id", "to_symbol_id").collect()} == {(1, i) for i in range(2, 11)} | {(2, 3)}
    assert not graph.around(edges, none, spark.range(40, 41), 1, 10)[2]


def test_first_writer_wins(spark):
    rows = spark.createDataFrame([(1, None, "b", 2), (1, None, "a", 1), (1, 5, "c", 3)], "k long, line int, via string, seq int")
    assert sorted(r["via"] for r in relations.first_written(rows, ["k", "line"], "seq").collect()) == ["a", "c"]
    assert sorted(r["via"] for r in relations.last_written(rows, ["k", "line"], "seq").collect()) == ["b", "c"]


def located(spark, rows):
    ddl = "id long, name string, fqn string, kind string, container_fqn string, signature string, modifiers array<string>, file_path string, start_line int"
    return spark.createDataFrame(rows, ddl)


def test_search_tiers(spark):
    rows = [
        (1, "save", "app.Order.save", "method", "app.Order", "save()", [], "a.rb", 1),
        (2, "save", "app.User.save", "method", "app.User", "save()", ["generated"], "b.rb", 1),
        (3, "total_given", "app.total_given", "method", "app", "", [], "c.rb", 1),
        (4, "totalXgiven", "app.totalXgiven", "method", "app", "", [], "c.rb", 2),
        (5, "resave", "app.resave", "function", "app", "", None, "c.rb", 3),
    ]
    symbols = located(spark, rows)
    hits = lambda q, **k: [(r["id"], r["score"]) for r in search.search(symbols, q, **k).collect()]
    assert hits("Order#save") == [(1, 100)]
    assert hits("SAVE") == [(1, 90), (2, 89), (5, 70)]
    assert hits("app.order.save") == [(1, 95)]
    assert [i for i, _ in hits("total_given")] == [3]  # the underscore is no wildcard
    assert hits("") == [] and hits("  ") == [] and hits("%") == []
    assert hits("save", kinds=["function"]) == [(5, 70)]
    assert [r["id"] for r in search.best_match(symbols, "save").collect()] == [1]
