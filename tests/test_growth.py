"""Jobs that must not grow with the square of a group beyond their answer, nor run in one task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.extract import raw_facts
from callweave.operators import blocks, cycles, graph, relations
from callweave.oracles import ORACLE_SQL
from callweave.plans.rendered import RUBY, TEXT
from callweave.plans.scratch import Scratch
from callweave.plans.star import Facts
from callweave.queries import QUERIES
from tests.conftest import SMALL
from tests.test_queries import edges_of


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("text", [TEXT, RUBY])
def test_rendered_files_come_of_many_tasks(spark, text):
    from callweave.plans.rendered import spread

    sql = spread(text).replace("{part}", f"parquet.`{SMALL}/part.parquet`").replace("{{", "{").replace("}}", "}")
    assert "Window" not in plan(spark.sql(sql))


def test_facts_leave_the_extractor_in_few_batches(spark):
    files = spark.range(50).coalesce(1).select(F.concat(F.lit("a/C"), "id", F.lit(".java")).alias("path"), F.lit("java").alias("lang"), F.lit("class C { void go() { at(); } }").alias("text"))
    batches = raw_facts(files).select("path").mapInArrow(lambda bs: iter([__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs]), "n long")
    assert batches.count() == 1


def test_pairs_that_share_keys_come_once(spark):
    rows = [(s, p, r, k, 1, "r" + str(s % 2)) for s, r in ((1, "consumer"), (2, "provider"), (4, "provider")) for p in ("http", "sqs") for k in ("a", "b", None)]
    bindings = spark.createDataFrame([*rows, (3, "http", "consumer", "b", None, "r1"), (None, "http", "provider", "b", 1, "r0")], "symbol_id long, plugin string, role string, key string, line int, repo_id string")
    got = relations.endpoint_pairs(bindings, F.lit("binds"), F.lit(0.9))
    rows = sorted((r["from_symbol_id"], r["to_symbol_id"], r["via"], r["line"] or 0) for r in got.collect())
    assert rows == [(1, 2, "binding:http", 1), (1, 2, "binding:sqs", 1), (1, 4, "binding:http", 1), (1, 4, "binding:sqs", 1), (3, 2, "binding:http", 0), (3, 4, "binding:http", 0)]
    assert not plan(got).startswith("Aggregate")  # the pairs aren't shuffled to be made distinct
    near = spark.createDataFrame([(2,), (3,)], "symbol_id long")
    both = lambda df: sorted((r["from_symbol_id"], r["to_symbol_id"], r["plugin"], r["key"]) for r in df.collect())
    assert both(relations.cross_repo_pairs(bindings, near)) == [x for x in both(relations.cross_repo_pairs(bindings)) if {2, 3} & set(x[:2])]


def test_candidates_are_not_shuffled_with_their_symbols(spark):
    text = plan(QUERIES["a13_candidate_callers"](spark, SMALL))
    assert text.index("Join") < text.index("Aggregate")


def test_paths_through_containers_equal_those_over_pairs(spark):
    symbols = Facts(spark, SMALL).symbols
    edges = Facts(spark, SMALL).edges.where("from_symbol_id % 3 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(graph.paths_from(edges, None, 0, 5, containers=relations.containers(symbols))) == rows(graph.paths_from(edges, relations.members(symbols), 0, 5))


def test_impact_in_rounds(spark, monkeypatch):
    edges = edges_of(spark, [(i + 1, i) for i in range(2200)])
    symbols = spark.range(2201).select("id", F.lit(1).alias("file_id"))
    files = spark.createDataFrame([(1, "a.rb")], "id long, path string")
    monkeypatch.setattr(graph, "ROUND", 1)
    got = graph.impact(edges, symbols, files, symbols.select(F.col("id").alias("seed"), "id"))
    assert {r["seed"]: r["total_symbols"] for r in got.collect()} == {i: min(4, 2200 - i) for i in range(2200)}


def test_every_symbol_is_asked_for_its_impact(spark):
    assert QUERIES["g2_impact"](spark, SMALL).where("seed % 100 <> 0").count() > 0


def test_no_stored_table_is_broadcast_by_its_files_size(spark, monkeypatch):
    """The driver ran out of memory on tables whose files are small and whose rows are not; here every table would be small enough."""
    joins: list[str] = []
    seen = lambda df: joins.extend(x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x)
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: (seen(df), save(self, df))[1])
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 40))
    try:
        seen(QUERIES["r4_diamond_calls"](spark, SMALL))
    finally:
        spark.conf.set(name, before)
    assert len(joins) > 50 and not [x for x in joins if "Broadcast" in x]


@pytest.mark.parametrize("seed", [1, 2])
def test_impact_shuffles_no_level(spark, monkeypatch, seed):
    """Every level of every block was joined and shuffled; now only graphs too large for a task's matrix are, with the same rows."""
    rng = np.random.default_rng(seed)
    pairs = sorted({tuple(x) for x in rng.integers(0, 60, (110, 2)).tolist()})
    edges = edges_of(spark, pairs)
    symbols = spark.createDataFrame([(i, i % 9) for i in range(50)], "id long, file_id int")  # some ends are no symbols, some symbols have no file
    files = spark.createDataFrame([(i, f"f{i // 2}") for i in range(8)], "id int, path string")
    starts = {i: [i] for i in range(60)} | {500: [1, 2, 3]}
    seeds = spark.createDataFrame([(s, i) for s, ids in starts.items() for i in ids], "seed long, id long")
    want = set()
    for s, ids in starts.items():
        seen, now, levels = set(ids), set(ids), []
        for _ in range(4):
            now = {a for a, b in pairs if b in now} - seen
            seen |= now
            levels.append([x for x in now if x < 50 and x % 9 < 8])
        if any(levels):
            want.add((s, sum(map(len, levels)), len({x % 9 // 2 for level in levels for x in level}), *map(len, levels)))
    rows = lambda df: {tuple(r) for r in df.select("seed", "total_symbols", "total_files", "level_1", "level_2", "level_3", "level_4").collect()}
    joined, reach = [], graph._reach
    monkeypatch.setattr(graph, "_reach", lambda *a: (joined.append(1), reach(*a))[1])
    assert rows(graph.impact(edges, symbols, files, seeds)) == want and not joined
    monkeypatch.setattr(blocks, "BYTES", 8)
    assert rows(graph.impact(edges, symbols, files, seeds)) == want and joined


def test_a_level_over_hot_targets(monkeypatch):
    monkeypatch.setattr(blocks, "STEP", 16)
    monkeypatch.setattr(blocks, "LONG", 40)
    rng = np.random.default_rng(3)
    dst = np.sort(np.concatenate([rng.integers(0, 200, 900), [7] * 300, [8] * 41])).astype(np.int32)
    src = rng.integers(0, 200, len(dst)).astype(np.int32)
    for live in (200, 3):  # also with few nodes that have bits
        now, new, want = np.zeros((200, 2), np.uint64), np.zeros((200, 2), np.uint64), np.zeros((200, 2), np.uint64)
        now[:live] = rng.integers(0, 1 << 62, (live, 2), dtype=np.uint64)
        for s, d in zip(src, dst, strict=True):
            want[d] |= now[s]
        blocks._level(now, new, iter([(src[:500], dst[:500]), (src[500:], dst[500:])]))
        assert (new == want).all()
        bits = np.unpackbits(want.view(np.uint8), axis=1, bitorder="little").sum(axis=0)
        assert (blocks.column_counts(want) == bits).all()


def dense(seed):
    rng = np.random.default_rng(seed)
    pairs = {tuple(x) for x in rng.integers(10, 50, (260, 2)).tolist()} | {(i, 49) for i in range(10, 50)} | {(49, i) for i in range(10, 50, 3)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    return pairs, [(a, b, c) for a, b in pairs if a < b for x, c in pairs if x == b and c > a and (c, a) in pairs]


@pytest.mark.parametrize("tile", [1 << 19, 40])
def test_short_rings_store_no_ways(spark, monkeypatch, tile):
    """A dense graph's ways of two links filled the disk; here hubs and a dense core, in one part and in many."""
    monkeypatch.setattr(cycles, "TILE", tile)
    monkeypatch.setattr(cycles, "_halves", None)
    pairs, want = dense(tile)
    links = spark.createDataFrame([(f"f{a}", f"f{b}") for a, b in [*pairs, (11, 11)]], "src string, dst string")
    want += [(a, b) for a, b in pairs if a < b and (b, a) in pairs]
    assert sorted(r["ring"] for r in cycles.rings(links, 2).collect()) == sorted([f"f{x}" for x in ring] for ring in want)
    assert cycles.rings(links, 1).count() == sum(len(ring) == 2 for ring in want)


@pytest.mark.parametrize("room", [1 << 26, 0])
def test_ways_back_by_bits_and_by_search(monkeypatch, room):
    monkeypatch.setattr(cycles, "BITS", room)
    monkeypatch.setattr(cycles, "WAYS", 7)
    pairs, want = dense(5)
    a, b = np.array(pairs, np.int32).T
    got = [tuple(x) for ends in cycles._thirds(a[a < b], b[a < b], [a, b], [a, b], (0, 0)) for x in np.array(ends).T.tolist()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["j10_endpoint_pairs", "j11_cross_repo_pairs", "j21_members", "a13_candidate_callers"])
def test_pairs_come_of_all_tasks(spark, name):
    """A small side was broadcast and the other read by one or two tasks, whatever the number of pairs."""
    assert QUERIES[name](spark, SMALL).select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_pairs_by_lists(spark, monkeypatch, most):
    monkeypatch.setattr(relations, "LIST", most)
    many = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else None, i % 3) for i in range(40)], "x long, k string, r int")
    few = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None, i % 3 if i % 4 else None, [i] if i % 3 else None) for i in range(30)], "y long, k string, s int, l array<int>")
    got = relations.met_by_lists(many, few, ["k"], "s", F.col("r") != F.col("s"))
    rows = lambda df: sorted(map(tuple, df.select("x", "k", "r", "y", "s", "l").collect()), key=repr)
    assert rows(got) == rows(many.join(few, "k").where("r <> s")) != []
    assert rows(relations.met_by_lists(many, few, ["k"])) == rows(many.join(few, "k"))


def test_pairs_of_many_shared_keys(spark):
    """More keys than the bits that stand for them."""
    rng = np.random.default_rng(8)
    rows = {(int(s), "p", "provider" if s % 2 else "consumer", f"k{k}", 1) for s, k in zip(rng.integers(0, 16, 900), rng.integers(0, 150, 900), strict=True)} | {(1, "p", "consumer", "k1", 1)}
    bindings = spark.createDataFrame(sorted(rows), "symbol_id long, plugin string, role string, key string, line int")
    want = sorted({(c[0], m[0]) for c in rows for m in rows if c[2] != m[2] == "provider" and c[3] == m[3] and c[0] != m[0]})
    assert sorted((r["from_symbol_id"], r["to_symbol_id"]) for r in relations.endpoint_pairs(bindings, F.lit("binds"), F.lit(0.9)).collect()) == want


def test_candidates_are_written_once_for_all_symbols_alike(spark):
    """Their lines and reasons were made text at each row of the answer, above the join."""
    text = plan(QUERIES["a13_candidate_callers"](spark, SMALL))
    assert text.index("Generate posexplode(id") < text.index("array_join")


def test_details_make_no_pairs_of_members(spark, same, monkeypatch):
    """Members were counted in pairs with each type of their container's name."""
    monkeypatch.setattr(relations, "met_evenly", None)
    same(QUERIES["g19_symbol_details"], ORACLE_SQL["g19_symbol_details"])
