"""Endpoints of a small tree, and their edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callweave import project
from callweave.operators import endpoints

TREE = {
    "Orders.java": """package a;
@RestController
@RequestMapping("/api/orders")
public class Orders {
  @GetMapping("/{id}") public Order show(String id) { return null; }
  @RequestMapping(method = RequestMethod.POST, value = {"/new", "/add"}) public void add(Order o) {}
  @DeleteMapping public void drop() {}
  @SqsListener(value = "order-events", factory = "f") public void onQueue(String m) {}
  @KafkaListener(topics = {"orders", "${x}"}, groupId = "g") public void onTopic(String m) {}
  @EventListener public void placed(OrderPlaced e) {}
}
""",
    "Client.java": """package a;
public class Client {
  void get() { restTemplate.getForObject("https://shop.example/api/orders/42", Order.class); }
  void put(Map m) { m.put("/api/orders/new", 1); webClient.put("/api/orders/none"); }
  void send() { queueTemplate.convertAndSend("https://sqs.example/1/order-events", "x"); mailSender.send("order-events"); }
  void topic() { kafkaTemplate.send("orders", "k"); }
  void event() { publisher.publishEvent(new OrderPlaced()); }
}
""",
    "OrderPlaced.java": "package a; class OrderPlaced {}",
    "Routes.java": """package a;
public class Routes { void configure() {
  to("seda:lost");
  from("SEDA:in?size=5")
    .to("direct:mid")
    .to("file:out");
  from("direct:mid")
    .wireTap("seda:in");
} }
""",
}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).write_text(text)
    return project.index(spark, str(root), "r")


def test_endpoints_and_edges(facts):
    rows = endpoints.collected(facts).persist()
    keys = {(r["plugin"], r["role"], r["key"]) for r in rows.collect()}
    for want in [
        ("http", "provider", "GET /api/orders/{}"), ("http", "provider", "ANY /api/orders/{}"), ("http", "provider", "POST /api/orders/new"), ("http", "provider", "POST /api/orders/add"), ("http", "provider", "DELETE /api/orders"),
        ("http", "consumer", "GET /api/orders/{}"), ("http", "consumer", "PUT /api/orders/none"), ("sqs", "provider", "order-events"), ("sqs", "consumer", "order-events"),
        ("kafka", "provider", "orders"), ("kafka", "consumer", "orders"), ("spring-event", "provider", "OrderPlaced"), ("spring-event", "consumer", "OrderPlaced"),
        ("camel", "provider", "seda:in"), ("camel", "provider", "direct:mid"), ("camel", "consumer", "direct:mid"), ("camel", "consumer", "seda:in"),
    ]:
        assert want in keys, want
    assert not any(k in ("PUT /api/orders/new", "f", "g", "seda:lost", "file:out") or "${" in k for _, _, k in keys)
    assert sum(1 for p, role, k in keys if (p, role) == ("sqs", "consumer")) == 1
    names = facts["symbols"].select("id", "name")
    pairs = {(r["a"], r["b"], r["kind"]) for r in endpoints.wired(rows).join(names.select(F.col("id").alias("from_symbol_id"), F.col("name").alias("a")), "from_symbol_id").join(names.select(F.col("id").alias("to_symbol_id"), F.col("name").alias("b")), "to_symbol_id").collect()}
    assert pairs == {("get", "show", "calls-route"), ("send", "onQueue", "sends-to"), ("topic", "onTopic", "sends-to"), ("event", "placed", "publishes-to")}


def test_migrations(spark):
    scripts = spark.createDataFrame([("db/V1__init.sql", "create table line_items (id int); create table other (x int)"), ("db/readme.sql", "create table orders (id int)")], "path string, text string")
    symbols = spark.createDataFrame([(1, "LineItem", "class"), (2, "Order", "class"), (3, "other", "method")], "id long, name string, kind string")
    assert [tuple(r) for r in endpoints.migrations(scripts, symbols).collect()] == [("db/V1__init.sql", "line_items", 1)]


def test_a_failing_plugin_is_left_out(facts):
    def broken(_):
        raise ValueError("no such table")

    plugins = endpoints.PLUGINS | {"broken": endpoints.Plugin(broken, "binds", 0.9), "unknown": endpoints.Plugin(lambda f: f["refs"].select("nothing"), "binds", 0.9)}
    failures = {}
    assert endpoints.collected(facts, plugins, failures).count() == endpoints.collected(facts).count()
    assert failures["broken"] == "ValueError: no such table" and failures["unknown"].startswith("AnalysisException")
    with pytest.raises(ValueError):
        endpoints.collected(facts, plugins)
