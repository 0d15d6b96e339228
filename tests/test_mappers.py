"""Mapper files: comments, attributes, places, and methods joined with their statements."""

from __future__ import annotations

import random
import re

from callweave.operators import mappers

TEXT = """<?xml version="1.0"?>
<!DOCTYPE mapper>
<mapper namespace='shop.OrderMapper'>
  <!-- retired:
  <select id="old">select 1</select> -->
  <SELECT resultType="x" id="find">
    select * from orders where a &lt; 1
  </SELECT>
  <insert
     id = "put">insert</insert><insert id="again">two
  </insert>
  <select resultType="y">no id</select>
  <sql id="cols">a, b</sql>
  <update id="open">
  <!-- never closed
</mapper>
"""


def test_statements_and_places():
    found = mappers.read_mapper(TEXT)
    assert [(r[1], r[2]) for r in found] == [("find", "select"), ("put", "insert"), ("again", "insert"), ("open", "update")]
    assert {r[0] for r in found} == {"shop.OrderMapper"}
    assert TEXT[found[1][3] : found[1][4]] == '<insert\n     id = "put">insert</insert>'
    assert mappers.lines_at(TEXT, [o for r in found for o in r[3:]]) == [6, 8, 9, 10, 10, 11, 14, 14]
    assert mappers.read_mapper("<project><select id='a'></select></project>") == [] == mappers.read_mapper("")


def test_blanks_keep_offsets():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["<!--", "-->", "a", "\n", "<", "-"]) for _ in range(20))
        got = mappers.blanked(text, "<!--", "-->")
        assert got == re.sub(r"<!--[\s\S]*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    places = sorted(rng.randrange(len(TEXT)) for _ in range(40))
    assert mappers.lines_at(TEXT, places) == [TEXT.count("\n", 0, p) + 1 for p in places]
    assert mappers.blanked("<!--" * 200_000, "<!--", "-->").count("<") == 200_000


def test_edges(spark):
    files = spark.createDataFrame([(9, TEXT), (8, None), (7, "<x/>")], "id long, text string")
    symbols = spark.createDataFrame([(1, "find", "method", "shop.OrderMapper", 4, 2), (2, "find", "method", "shop.Other", 4, 2), (3, "gone", "method", "shop.OrderMapper", 5, 2), (4, "put", "field", "shop.OrderMapper", 6, 2)], "id long, name string, kind string, container_fqn string, start_line int, file_id long")
    bindings, edges = mappers.mapped(mappers.statements(files), symbols)
    assert [(r["from_symbol_id"], r["confidence"], r["line"]) for r in edges.collect()] == [(1, 0.95, 4)]
    assert sorted((r["role"], r["key"]) for r in bindings.collect()) == sorted([("provider", f"shop.OrderMapper#{n}") for n in ("find", "put", "again", "open")] + [("consumer", "shop.OrderMapper#find"), ("consumer", "shop.OrderMapper#gone")])
