"""A source tree end to end: extraction, resolution, storage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callweave import project
from callweave.extract.java import extract_java, lex, simple_type

TREE = {
    "src/shop/Repo.java": "package shop;\npublic interface Repo { Order load(String id); void put(Order o); }\n",
    "src/shop/SqlRepo.java": "package shop;\nimport org.db.sql.Pool;\npublic class SqlRepo extends Base implements Repo {\n  private Pool pool;\n  public Order load(String id) { pool.query(id); return new Order(id); }\n  public void put(Order o) { audit(o); }\n}\n",
    "src/shop/Base.java": "package shop;\nclass Base { protected void audit(Object o) { helper(); } private void helper() {} }\n",
    "src/shop/Order.java": "package shop;\n@Getter @Setter\npublic class Order {\n  private String id;\n  private Customer customer;\n  public Order(String id) { this.id = id; }\n  public void pay(int cents) {}\n  public void pay(int cents, String note) {}\n}\n",
    "src/shop/Customer.java": "package shop;\npublic record Customer(String name) { public String label() { return name().trim(); } }\n",
    "src/shop/web/Api.java": """package shop.web;
import shop.*;
import static java.lang.Math.max;
public class Api {
  private final Repo repo;
  Api(Repo repo) { this.repo = repo; }
  @GetMapping("/orders/{id}")
  public Order show(String id) {
    Order o = repo.load(id);
    o.pay(1);
    o.pay(max(1, 2), "n");
    String n = o.getCustomer().label();
    var p = repo.load(id).getCustomer();
    p.label();
    repo.vanish(id);
    undeclared(id);
    thing.audit(o);
    return o;
  }
}
""",
}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return project.index(spark, str(root), "r")


@pytest.fixture(scope="module")
def edges(indexed):
    s = indexed["symbols"]
    a, b = s.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("f"), F.col("arity").alias("fa")), s.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("t"), F.col("arity").alias("ta"))
    return {(r["f"], r["t"], r["ta"], r["kind"], r["confidence"], r["via"]) for r in indexed["edges"].join(a, "from_symbol_id").join(b, "to_symbol_id").collect()}


def test_edges(edges):
    show, sql = "shop.web.Api.show", "shop.SqlRepo"
    for want in [
        (sql, "shop.Base", None, "extends", 1.0, "declaration"),
        (sql, "shop.Repo", None, "implements", 1.0, "declaration"),
        (show, "shop.Repo.load", 1, "calls", 1.0, "direct"),
        (show, "shop.SqlRepo.load", 1, "calls", 0.9, "interface->impl"),
        (show, "shop.Order.pay", 1, "calls", 1.0, "direct"),
        (show, "shop.Order.pay", 2, "calls", 1.0, "direct"),
        (show, "shop.Order.getCustomer", 0, "calls", 1.0, "direct"),
        (show, "shop.Customer.label", 0, "calls", 1.0, "direct"),
        (show, "shop.Base.audit", 1, "calls", 0.5, "unique-name"),
        ("shop.SqlRepo.load", "shop.Order", None, "instantiates", 1.0, "direct"),
        ("shop.SqlRepo.load", "shop.Order.Order", 1, "calls", 1.0, "constructor"),
        ("shop.SqlRepo.put", "shop.Base.audit", 1, "calls", 1.0, "direct"),
        ("shop.Base.audit", "shop.Base.helper", 0, "calls", 1.0, "direct"),
        ("shop.Customer.label", "shop.Customer.name", 0, "calls", 1.0, "direct"),
    ]:
        assert want in edges, want


def test_every_call_has_one_outcome(indexed):
    refs = indexed["refs"]
    reasons = {(r["name"], r["receiver"]): (r["reason"], r["external"]) for r in indexed["unresolved"].join(refs.select(F.col("id").alias("ref_id"), "name", "receiver"), "ref_id").collect()}
    assert reasons[("query", "pool")] == ("external:org.db.sql", 1) and reasons[("vanish", "repo")] == ("external:not-in-project", 1) and reasons[("undeclared", None)] == ("external:not-in-project", 1)
    assert reasons[("max", None)][0] == "external:java.lang.Math"
    assert indexed["unresolved"].count() == indexed["unresolved"].select("ref_id").distinct().count()
    calls = refs.where("kind <> 'annotation'")
    places = indexed["edges"].where("kind <> 'extends' and kind <> 'implements'").select("from_symbol_id", "line").distinct()
    loose = calls.join(indexed["unresolved"].select(F.col("ref_id").alias("id")), "id", "left_anti").join(places, ["from_symbol_id", "line"], "left_anti")
    assert loose.count() == 0


def test_both_ends_exist_and_annotations_are_kept(indexed):
    ids = indexed["symbols"].select("id")
    for end in ("from_symbol_id", "to_symbol_id"):
        assert indexed["edges"].select(F.col(end).alias("id")).join(ids, "id", "left_anti").count() == 0
    notes = {(r["name"], tuple(r["str_args"])) for r in indexed["refs"].where("kind = 'annotation'").collect()}
    assert ("@GetMapping", ("/orders/{id}",)) in notes


def test_stored_facts_come_back(spark, indexed, tmp_path):
    for _ in range(2):  # writing again replaces
        project.write(indexed, str(tmp_path), "a")
    project.write(indexed, str(tmp_path), "b")
    back = project.read(spark, str(tmp_path), "a")
    assert {n: back[n].count() for n in project.NAMES} == {n: indexed[n].count() for n in project.NAMES}
    assert project.read(spark, str(tmp_path))["edges"].count() == 2 * indexed["edges"].count()


def test_extractor_on_odd_sources():
    for text in ("", "}", "class", "class A {", "class A { void f( }", 'class A { String s = "a\\"b{"; /* } */ char c = \'}\'; }', "@", "package", "import x"):
        extract_java(text, "A.java")
    found = extract_java('class A { String s = "x{"; void f() { g("}"); } }', "A.java")
    assert [s["name"] for s in found.symbols] == ["A", "s", "f"] and found.refs[0]["str_args"] == ["}"]
    assert [t.line for t in lex("a\n/* \n */ b")] == [1, 3]
    assert simple_type("List<? extends User>") == ("List", "User") and simple_type("Map<K, V>") == ("Map", None) and simple_type("int[]...") == ("int", None)


def test_mermaid():
    text = project.mermaid([(1, 'A "x"', "class"), (2, "f", "method")], [(1, 2, "declares")], True)
    assert text.splitlines()[1:] == ['  n1(["A #quot;x#quot;"])', '  n2["f"]', "  n1 -->|declares| n2", "  %% more nodes were left out"]


def test_a_file_nested_too_deep_ends_nothing(spark):
    from callweave.extract import facts, raw_facts, unparsable

    deep = "class A { void a() { " + "f(" * 5_000 + ")" * 5_000 + "; } }"
    files = spark.createDataFrame([("a/A.java", "java", deep, "x", 1), ("a/B.java", "java", "class B { void b() { b(); } }", "y", 1)], "path string, lang string, text string, hash string, lines int")
    raw = raw_facts(files).cache()
    assert [r["path"] for r in unparsable(raw).collect()] == ["a/A.java"]
    made = facts(files, raw, "r")
    assert made["files"].count() == 2 and {r["name"] for r in made["symbols"].collect()} == {"B", "b"}
