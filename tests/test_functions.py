"""Column functions on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callweave.functions import names, predicates, routes
from callweave.sources.files import admission, ignored, read_tree
from callweave.streaming.sync import compared, watch


@pytest.fixture(scope="module")
def value(spark):
    row = spark.range(1)
    return lambda column: row.select(column.alias("v")).first()["v"]


L = F.lit


@pytest.mark.parametrize(("word", "want"), [("line_items", "LineItem"), ("stories", "Story"), ("boxes", "Box"), ("status", "Status"), ("addresses", "Address"), ("analysis", "Analysis"), ("user", "User"), ("httpURLs", "HttpURL")])
def test_classify(value, word, want):
    assert value(names.classify(L(word))) == want


def test_candidate_models(value):
    assert value(names.candidate_models(L("account_aliases")))[:2] == ["AccountAlias", "AccountAliase"] or "AccountAlias" in value(names.candidate_models(L("account_aliases")))
    assert value(names.class_names(L("orders"))) == ["Order", "Order", "orders", "order"] or set(value(names.class_names(L("orders")))) == {"Order", "orders", "order"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("/orders/42", "/orders/{}"), ("orders/{id}/", "/orders/{}"), ("/orders/:id", "/orders/{}"), ("/orders/<int:id>", "/orders/{}"), ("https://h.example/a//b?x=1#y", "/a/b"),
        ("https://h.example", "/"), ("https://h.example?x", "/"), ("${base.path}", None), ("#{base}/x", None), ("a b", None), ("", None), ("/", "/"), ("/v1/${x}/y", "/v1/{}/y"), ("/a/1/2", "/a/{}/{}"),
    ],
)
def test_normal_path(value, raw, want):
    assert value(routes.normal_path(L(raw))) == want


def test_keys(value):
    assert value(routes.route_key(L("GET"), L("/a/1"))) == "GET /a/{}"
    assert value(routes.join_paths(L("/api/"), L("/x"))) == "/api/x" and value(routes.join_paths(L(""), L("/x"))) == "/x" and value(routes.join_paths(L("/api"), L("/"))) == "/api"
    assert value(routes.endpoint_uri(L("SEDA:orders?concurrentConsumers=5"))) == "seda:orders" and value(routes.endpoint_uri(L("plain"))) is None
    assert value(routes.queue_name(L("https://sqs.example/1/order-events"))) == "order-events" and value(routes.queue_name(L("${queue}"))) is None
    assert value(routes.topic_name(L("orders"))) == "orders" and value(routes.topic_name(L("orders.*"))) is None
    assert value(routes.event_type(L("com.shop.OrderPlaced<T>"))) == "OrderPlaced" and value(routes.event_type(L("Event"))) is None and value(routes.event_type(L("T"))) is None
    assert value(routes.schema_coordinate(L("Query"), L("orders"))) == "Query.orders" and value(routes.rpc_coordinate(L("S"), L("a-b"))) is None
    assert value(routes.service_of_base(L("OrderGrpc.OrderImplBase"), F.array())) == "Order"
    assert value(routes.service_of_base(L("OrderImplBase"), F.array(L("x.OrderGrpc.OrderImplBase")))) == "Order" and value(routes.service_of_base(L("FooImplBase"), F.array(L("x.Y")))) is None


def test_tables(value):
    sql = 'CREATE TABLE IF NOT EXISTS "public"."Comments" (id int); -- DROP TABLE old\n/* ALTER TABLE x */ alter table `a`.b add c; UPDATE t SET x=1; create unique index i on idx (a); INSERT INTO logs VALUES (1)'
    assert set(value(routes.tables_touched(L(sql)))) == {"comments", "b", "t", "idx", "logs"}
    assert set(value(routes.tables_referenced(L("select * from A.Orders o join lines l on 1=1 where x in (select y from z)")))) == {"orders", "lines", "z"}


def test_attributes(value):
    raw = 'topics = {"a", "b"}, groupId = "g"'
    assert value(routes.attribute_strings(L(raw), ["topics"])) == ["a", "b"] and value(routes.attribute_strings(L(raw), ["value", "groupId"])) == ["g"]
    assert value(routes.attribute_strings(L('"orders"'), ["value"])) == ["orders"] and value(routes.attribute_strings(L('x = "y"'), ["value"])) == []
    assert value(routes.attribute_identifiers(L("value = \"/x\", method = RequestMethod.POST"), "method")) == ["RequestMethod", "POST"]


@pytest.mark.parametrize(
    ("path", "want"),
    [("src/test/A.java", True), ("a/Spec/x.rb", True), ("x/DepositTest.java", True), ("x/Deposit.java", False), ("x/OrderIT.java", True), ("x/Commit.java", False), ("a_spec.rb", True), ("a.TEST.ts", True), ("a.spec.mjs", True), ("contest/a.ts", False)],
)
def test_test_paths(value, path, want):
    assert value(predicates.is_test_path(L(path))) is want


def test_arity(value):
    fits = lambda arity, sig, lang, call: value(predicates.arity_fits(L(arity).cast("int"), L(sig), L(lang), L(call).cast("int")))
    assert fits(0, "save(*args)", "ruby", 3) and not fits(0, "save()", "ruby", 1) and fits(2, "save(a, b)", "ruby", 1)
    assert fits(1, "f(a)", "java", 1) and not fits(1, "f(a)", "java", 0) and fits(1, "f(String... a)", "java", 4) and fits(None, "", "java", 4)


def test_names(value):
    assert value(names.module_path(L("types/api.d.ts"))) == "types/api" and value(names.module_path(L("a/b.jsx"))) == "a/b"
    assert value(names.package_of(L("@s/p/q"))) == "@s/p" and value(names.package_of(L("p/q"))) == "p" and value(names.package_of(L("./x"))) is None
    assert value(names.bean_forms(L("getTotal"))) == ["getTotal", "Total", "total"] and value(names.bean_forms(L("gets"))) == ["gets"]
    assert value(names.has_phrase(L("find_by_id"), L("by ID"))) and not value(names.has_phrase(L("findbyid"), L("by id")))
    assert value(names.percent(L(1), L(0))) == 0.0 and value(names.percent(L(397), L(400))) == 99.3
    assert [value(names.clamp(L(x), 20, 1, 200)) for x in ("-1", "7", "9999", "x", "")] == [1, 7, 200, 20, 20]
    assert value(names.language(L("a/b.tsx"))) == "tsx" and value(names.language(L("Makefile"))) is None


def test_admission(value):
    assert value(admission(L("x = 1\n"))) == "ok" and value(admission(L("a\0b"))) == "binary"
    assert value(admission(L("x" * 30_000))) == "packed" and value(admission(L("x\n" * 15_000))) == "ok" and value(admission(L("x\n" * 1_100_000))) == "too-large"


@pytest.mark.parametrize(("path", "want"), [("a/b.log", True), ("keep.log", False), ("gen/x/y.ts", True), ("src/gen/y.ts", False), ("tmp/a.rb", True), ("x/tmp/a.rb", True), ("deep/a/b/z.js", True), ("src/a.rb", False)])
def test_ignored(value, path, want):
    assert value(ignored(L(path), ["# c", "*.log", "!keep.log", "/gen", "tmp/", "deep/**/z.js"])) is want


def test_read_tree(spark, tmp_path):
    for name, text in {"a/B.java": "class B {}\n", "a/c.rb": "x\ny", "node_modules/d.js": "1", ".git/e.js": "1", "f.txt": "t", "a/skip.ts": "s"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r["path"]: (r["lang"], r["lines"], r["admission"]) for r in read_tree(spark, str(tmp_path), ["skip.ts"]).collect()}
    assert got == {"a/B.java": ("java", 2, "ok"), "a/c.rb": ("ruby", 2, "ok")}


def test_sync_stream(spark, tmp_path):
    listing, seen = str(tmp_path / "in"), []
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string").write.parquet(listing)
    query = watch(spark, listing, "path string, hash string", lambda df, _: seen.extend((r["path"], r["status"]) for r in compared(stored, df).collect()), str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    assert sorted(seen) == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")]
