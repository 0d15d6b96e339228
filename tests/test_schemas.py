"""Schema files: fields, rpcs and statements as symbols; what answers them; a tree and its change."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from callweave import project
from callweave.extract.schema import extract_graphql, read_graphql, read_proto
from callweave.operators import endpoints
from callweave.oracles import ORACLE_SQL
from callweave.queries import QUERIES

GRAPHQL = '''"""Returns: text"""
schema { query: Query }
scalar Date
input Filter { by: String }
enum Kind { A B }
type Query @key(fields: "id") {
  "a: description" orders(
    first: Int = 5
    filter: Filter = {by: "x"}
  ): [Order!]! @cost(weight: 1)
  one: Order # two: Order
  type: Kind  other: Int
}
extend type Query { late: Date }
interface Node implements Base & Other { id: ID! }
union All = Query | Order
type Empty
input After { no: Int }
type Open { last: Int
'''
PROTO = """syntax = "proto3"; // service Old { rpc Gone (A) returns (B); }
message service { string rpc = 1; }
service Orders {
  rpc GetOrder (Req) returns (Res) { option (google.api.http) = { get: "/v1/{id}}" }; }
  /* rpc No (A) returns (B); */
  rpc
    ListOrders(Req) returns (stream Res);
}
rpc Loose (A) returns (B);
service Second{rpc Put(A) returns (B);}
"""
TREE = {
    "schema/main.graphqls": "type Query {\n  orders: [Order]\n  byId(id: ID): Order\n}\ntype Order {\n  customer: Customer\n}\n",
    "schema/nest.GQL": "extend type Query {\n  items: [Item]\n  plain: Int\n}\n",
    "proto/orders.proto": "service OrderService {\n  rpc GetOrder (A) returns (B);\n}\n",
    "map/OrderMapper.xml": '<mapper namespace="a.OrderMapper">\n<select id="find">select 1</select>\n</mapper>\n',
    "pom.xml": "<project><select id='a'></select></project>",
    "a/OrderMapper.java": "package a; interface OrderMapper { Order find(long id); }",
    "a/Shop.java": """package a;
class Shop {
  @Deprecated @QueryMapping public Object orders() { return null; }
  @QueryMapping("byId") public Object one(String id) { return null; }
  @SchemaMapping(field = "customer", typeName = "Order") public Object who(Order o) { return null; }
  @SchemaMapping("customer") public Object lone(Order o) { return null; }
}
""",
    "a/Server.java": "package a;\nimport gen.OrderServiceGrpc.OrderServiceImplBase;\nclass Server extends OrderServiceImplBase {\n  public void getOrder(A a) { }\n  public void extra() { }\n}\n",
    "a/Full.java": "package a;\nclass Full extends OrderServiceGrpc.OrderServiceImplBase {\n  public void getOrder(A a) { }\n}\n",
    "b/Other.java": "package b;\nclass Other extends OrderServiceImplBase {\n  public void getOrder(A a) { }\n}\n",
    "web/items.ts": "export class Items {\n  @Query(() => [Item], { name: 'items' })\n  findAll() { return []; }\n  @Query(() => Number)\n  plain() { return 1; }\n  @ResolveField('customer')\n  customer() { return 1; }\n}\n",
}


def test_fields():
    got = read_graphql(GRAPHQL)
    assert [(t, f) for t, f, _, _ in got] == [("Query", "orders"), ("Query", "one"), ("Query", "type"), ("Query", "other"), ("Query", "late"), ("Node", "id"), ("Open", "last")]
    text = {f: GRAPHQL[a:b] for _, f, a, b in got}
    assert text["one"] == "one: Order" and text["type"] == "type: Kind" and text["last"] == "last: Int" and text["orders"].endswith("@cost(weight: 1)")
    rows = {r["name"]: r for r in extract_graphql(GRAPHQL, "x").symbols}
    assert rows["orders"]["signature"] == 'orders( first: Int = 5 filter: Filter = {by: "x"} ): [Order!]! @cost(weight: 1)' and (rows["orders"]["start_line"], rows["orders"]["end_line"]) == (7, 10)
    assert rows["orders"]["fqn"] == "graphql:Query.orders" and rows["late"]["start_line"] == 14


def test_methods():
    got = read_proto(PROTO)
    assert [(s, r) for s, r, _, _ in got] == [("Orders", "GetOrder"), ("Orders", "ListOrders"), ("Second", "Put")]
    assert PROTO[got[0][2] : got[0][3]] == "rpc GetOrder ("


def test_any_text_is_read():
    rng = random.Random(5)
    parts = ["type ", "Q", "{", "}", "(", ")", ":", '"""', '"', "#", "\n", " a", "@", "service ", "rpc ", "/*", "*/", "//", "[", "]"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(40))
        assert all(0 <= a <= b <= len(text) for rows in (read_graphql(text), read_proto(text)) for _, _, a, b in rows)
    assert read_graphql("") == read_proto("") == []
    assert len(read_graphql("type Q {" + " a: Int" * 100_000)) == 100_000 and read_graphql("{" * 100_000) == []


def _tree(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def _edges(facts):
    names = facts["symbols"].select("id", "fqn")
    made = endpoints.wired(endpoints.collected(facts)).where("via in ('binding:graphql', 'binding:grpc', 'binding:mybatis')")
    made = made.join(names.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("a")), "from_symbol_id").join(names.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("b")), "to_symbol_id")
    return {(r["a"], r["b"], r["confidence"]) for r in made.collect()}


def test_tree(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    _tree(root, TREE)
    facts = project.index(spark, str(root), "r")
    got = {(a, b.rpartition(":")[2] if b.startswith("web") else b, c) for a, b, c in _edges(facts)}
    assert got == {
        ("graphql:Query.orders", "a.Shop.orders", 0.9), ("graphql:Query.byId", "a.Shop.one", 0.9), ("graphql:Order.customer", "a.Shop.who", 0.9), ("graphql:Query.items", "Items#findAll", 0.9), ("graphql:Query.plain", "Items#plain", 0.9),
        ("rpc:OrderService/GetOrder", "a.Server.getOrder", 0.9), ("rpc:OrderService/GetOrder", "a.Full.getOrder", 0.9), ("a.OrderMapper.find", "sql:a.OrderMapper#find", 0.95),
    }
    assert {r["path"] for r in facts["files"].where("lang = 'xml'").collect()} == {"map/OrderMapper.xml"}
    alone = {r["key"] for r in endpoints.grpc(facts).where("role = 'provider'").collect()}
    assert alone == {"OrderService/GetOrder", "OrderService/extra"}
    project.write(facts, store, "r")
    (root / "proto/orders.proto").write_text("service OrderService {\n  rpc Extra (A) returns (B);\n}\n")
    assert project.sync(spark, str(root), store, "r") == {"unchanged": len(TREE) - 2, "changed": 1}
    after = {(a, b) for a, b, _ in _edges(project.read(spark, store, "r")) if a.startswith("rpc:")}
    assert after == {("rpc:OrderService/Extra", "a.Server.extra")}


def test_queries(same, spark):
    for name in ("b8_schema_fields", "b8_schema_edges", "b9_rpc_methods", "b9_rpc_edges"):
        same(QUERIES[name], ORACLE_SQL[name])
        assert not QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()
