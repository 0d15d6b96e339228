"""Incremental indexing equals indexing from scratch."""

from __future__ import annotations

from callweave import project


def rows(tables, name):
    return sorted((tuple(map(str, r)) for r in tables[name].select(sorted(tables[name].columns)).collect()))


def test_incremental_equals_full(spark, tmp_path):
    root, store, fresh = tmp_path / "tree", str(tmp_path / "store"), str(tmp_path / "fresh")
    root.mkdir()
    (root / "A.java").write_text("package p; class A { void a() { new B().b(); } }")
    (root / "B.java").write_text("package p; class B { void b() { c(); } void c() {} }")
    (root / "c.rb").write_text("class C\n  def x\n    y\n  end\n  def y\n  end\nend\n")
    project.write(project.index(spark, str(root), "r"), store, "r")
    assert project.sync(spark, str(root), store, "r") == {"unchanged": 3}
    (root / "B.java").write_text("package p; class B { void b() {} }")
    (root / "D.java").write_text("package p; class D { void d() { new A().a(); } }")
    (root / "c.rb").unlink()
    assert project.sync(spark, str(root), store, "r") == {"unchanged": 1, "changed": 1, "added": 1, "removed": 1}
    project.write(project.index(spark, str(root), "r"), fresh, "r")
    a, b = project.read(spark, store, "r"), project.read(spark, fresh, "r")
    for name in project.NAMES:
        assert rows(a, name) == rows(b, name), name
    ids = {r["id"] for r in a["symbols"].collect()}
    assert all(r["from_symbol_id"] in ids and r["to_symbol_id"] in ids for r in a["edges"].collect()) and a["edges"].count() >= 3
