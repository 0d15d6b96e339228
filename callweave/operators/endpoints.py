"""Framework endpoints: what declares a route, queue, topic, event or endpoint, and what uses it, joined on the shared key.

A plugin takes the fact tables and returns ``file_id, symbol_id, role, key, line, detail``; its edge kind and confidence
stand beside it in ``PLUGINS``. A plugin that fails is left out and reported, the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.functions.names import class_names
from callweave.functions.routes import attribute_identifiers, attribute_strings, endpoint_uri, event_type, join_paths, queue_name, route_key, rpc_coordinate, schema_coordinate, service_of_base, tables_touched, topic_name
from callweave.operators.relations import endpoint_pairs, types_view

Facts = dict[str, DataFrame]

#: The names that frameworks give their annotations and clients.
SPRING_VERBS = {"@GetMapping": "GET", "@PostMapping": "POST", "@PutMapping": "PUT", "@DeleteMapping": "DELETE", "@PatchMapping": "PATCH"}
CLIENT_VERBS = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "patchForObject": "PATCH", "put": "PUT", "delete": "DELETE", "exchange": "ANY", "uri": "ANY"}
CLIENT_GENERIC = ["put", "delete", "exchange", "uri"]
QUEUE_LISTENERS = ["@SqsListener", "@SqsHandler", "@JmsListener", "@RabbitListener"]
QUEUE_ATTRIBUTES = ["value", "queueNames", "queues", "destination"]
QUEUE_SENDERS = ["send", "sendMessage", "convertAndSend", "sendMessageBatch"]
TOPIC_LISTENERS = ["@KafkaListener", "@StreamListener", "@KafkaHandler"]
EVENT_LISTENERS = ["EventListener", "TransactionalEventListener"]
ROUTE_SENDERS = ["to", "toD", "toF", "wireTap", "enrich", "pollEnrich", "recipientList", "inOut", "inOnly"]
ROUTABLE = "^(direct|seda|vm|direct-vm|activemq|jms|rabbitmq|kafka|sqs|aws2-sqs|stream):"
GRAPHQL_ROOTS = {"QueryMapping": "Query", "MutationMapping": "Mutation", "SubscriptionMapping": "Subscription"}
DECORATOR_ROOTS = ["Query", "Mutation", "Subscription"]

OUT = ["file_id", "symbol_id", "role", "key", "line", "detail"]


def _raw() -> Column:
    return F.try_element_at("arg_types", F.lit(1))


def _first() -> Column:
    return F.try_element_at("str_args", F.lit(1))


def _emit(rows: DataFrame, role: str, key: Column, detail: Column) -> DataFrame:
    return rows.select("file_id", F.col("from_symbol_id").alias("symbol_id"), F.lit(role).alias("role"), key.alias("key"), "line", detail.alias("detail")).where("key is not null and symbol_id is not null")


def http(facts: Facts) -> DataFrame:
    """Spring handlers, each under its verb and under ANY, with the prefix of its class; Java clients by their first string."""
    refs, symbols = facts["refs"], facts["symbols"]
    notes = refs.where("kind = 'annotation'")
    owners = symbols.select(F.col("id").alias("from_symbol_id"), "fqn", "kind", "container_fqn").withColumnRenamed("kind", "owner_kind")
    mapped = notes.where(F.col("name").isin("@RequestMapping", *SPRING_VERBS)).join(owners, "from_symbol_id")
    is_type = F.col("owner_kind").isin("class", "interface")
    paths = attribute_strings(_raw(), ["value", "path"])
    prefixes = mapped.where(is_type & (F.col("name") == "@RequestMapping")).groupBy(F.col("fqn").alias("container_fqn")).agg(F.min_by(F.try_element_at(paths, F.lit(1)), "line").alias("prefix"))
    verb = F.lit(None).cast("string")
    for note, v in SPRING_VERBS.items():
        verb = F.when(F.col("name") == note, v).otherwise(verb)
    methods = F.filter(attribute_identifiers(_raw(), "method"), lambda x: x.isin("GET", "POST", "PUT", "DELETE", "PATCH"))
    verbs = F.when(verb.isNotNull(), F.array(verb)).when(F.size(methods) > 0, methods).otherwise(F.array(F.lit("ANY")))
    served = mapped.where(~is_type).join(prefixes, "container_fqn", "left").select("*", F.explode(F.when(F.size(paths) > 0, paths).otherwise(F.array(F.lit("")))).alias("path"), verbs.alias("verbs"))
    each = served.select("*", F.explode(F.array_distinct(F.concat("verbs", F.array(F.lit("ANY"))))).alias("verb"))
    full = F.when(join_paths(F.col("prefix"), F.col("path")) == "", "/").otherwise(join_paths(F.col("prefix"), F.col("path")))
    made = _emit(each, "provider", route_key(F.col("verb"), full), F.concat_ws(" ", "name", route_key(F.try_element_at("verbs", F.lit(1)), full)))
    client = F.lit(None).cast("string")
    for name, v in CLIENT_VERBS.items():
        client = F.when(F.col("name") == name, v).otherwise(client)
    calls = refs.where("kind = 'call'").where(F.col("name").isin(*CLIENT_VERBS)).where(~F.col("name").isin(*CLIENT_GENERIC) | F.coalesce("receiver", F.lit("")).rlike("(?i)rest|template|client|http|web|feign|request"))
    calls = calls.where(_first().rlike("(?i)^(/|https?://)"))  # other strings are no routes
    used = _emit(calls, "consumer", route_key(client, _first()), F.concat_ws(" ", "name", _first()))
    return made.unionByName(used)


def sqs(facts: Facts) -> DataFrame:
    refs = facts["refs"]
    heard = refs.where("kind = 'annotation'").where(F.col("name").isin(*QUEUE_LISTENERS)).select("*", F.explode(F.when(_raw().isNotNull(), attribute_strings(_raw(), QUEUE_ATTRIBUTES)).otherwise(F.col("str_args"))).alias("arg"))
    generic = F.col("name").isin("send", "convertAndSend")
    sent = refs.where("kind = 'call'").where(F.col("name").isin(*QUEUE_SENDERS)).where(~generic | F.coalesce("receiver", F.lit("")).rlike("(?i)sqs|queue|jms|rabbit|amqp|messag"))
    said = lambda q: F.concat("name", F.lit('("'), q, F.lit('")'))
    return _emit(heard, "provider", queue_name("arg"), said(queue_name("arg"))).unionByName(_emit(sent, "consumer", queue_name(_first()), said(queue_name(_first()))))


def kafka(facts: Facts) -> DataFrame:
    refs = facts["refs"]
    heard = refs.where("kind = 'annotation'").where(F.col("name").isin(*TOPIC_LISTENERS)).select("*", F.explode(attribute_strings(_raw(), ["topics", "value", "target"])).alias("arg"))
    sent = refs.where("kind = 'call' and name in ('send', 'sendDefault')").where(F.coalesce("receiver", F.lit("")).rlike("(?i)kafka|stream"))
    back = refs.where("kind = 'annotation' and name = '@SendTo'")
    said = lambda q: F.concat("name", F.lit('("'), q, F.lit('")'))
    return _emit(heard, "provider", topic_name("arg"), said(topic_name("arg"))).unionByName(_emit(sent.unionByName(back), "consumer", topic_name(_first()), said(topic_name(_first()))))


def spring_event(facts: Facts) -> DataFrame:
    """Listeners by their first parameter; publishers by the first ``new`` on the line of the call."""
    refs, symbols = facts["refs"], facts["symbols"]
    heard = symbols.where("kind = 'method'").where(F.arrays_overlap(F.transform("annotations", lambda a: F.regexp_replace(a, "^@", "")), F.array(*[F.lit(x) for x in EVENT_LISTENERS])))
    made = heard.select("file_id", F.col("id").alias("symbol_id"), F.lit("provider").alias("role"), event_type(F.try_element_at("params", F.lit(1))).alias("key"), F.col("start_line").alias("line"), F.lit("@EventListener").alias("detail")).where("key is not null")
    # Ids of one file ascend as it is read.
    first = refs.where("kind = 'new' and from_symbol_id is not null").groupBy("from_symbol_id", "line").agg(F.min_by("name", "id").alias("event"))
    published = refs.where("kind = 'call' and name in ('publishEvent', 'publish', 'multicastEvent')").where((F.col("name") != "publish") | F.coalesce("receiver", F.lit("")).rlike("(?i)publisher|event|context"))
    return made.unionByName(_emit(published.join(first, ["from_symbol_id", "line"]), "consumer", event_type("event"), F.col("name")))


def camel(facts: Facts) -> DataFrame:
    """Routes by their last ``from`` above: a running last value over each method's calls; a send before any is no route's."""
    uri = endpoint_uri(_first())
    calls = facts["refs"].where("kind = 'call' and from_symbol_id is not null").where(F.col("name").isin("from", *ROUTE_SENDERS)).withColumn("uri", uri).where(F.col("uri").rlike(ROUTABLE))
    above = Window.partitionBy("from_symbol_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = calls.withColumn("route", F.last(F.when(F.col("name") == "from", F.col("uri")), ignorenulls=True).over(above)).where("route is not null")
    symbol = F.xxhash64("from_symbol_id", F.lit("route"), "route")
    rows = placed.withColumn("from_symbol_id", symbol)
    return _emit(rows.where("name = 'from'"), "provider", F.col("uri"), F.col("uri")).unionByName(_emit(rows.where("name <> 'from'"), "consumer", F.col("uri"), F.concat("route", F.lit(" -> "), "uri")))


def _declared(symbols: DataFrame, kind: str, role: str) -> DataFrame:
    """Symbols of schema files; their full names are the keys behind a prefix."""
    return symbols.where(F.col("kind") == kind).select("file_id", F.col("id").alias("symbol_id"), F.lit(role).alias("role"), F.regexp_replace("fqn", "^[a-z]+:", "").alias("key"), F.col("start_line").alias("line"), F.col("signature").alias("detail"))


def _answering(methods: DataFrame, key: Column, detail: Column) -> DataFrame:
    return methods.select("file_id", F.col("id").alias("symbol_id"), F.lit("provider").alias("role"), key.alias("key"), F.col("start_line").alias("line"), detail.alias("detail")).where("key is not null")


def graphql(facts: Facts) -> DataFrame:
    """Schema fields, and the methods that answer them: by mapping annotations, or decorators that may name the field in their options.

    A decorator of one field without its type names no coordinate and is left out.
    """
    refs, symbols = facts["refs"], facts["symbols"]
    bare = lambda a: F.regexp_extract(a, r"^@?([\w.$]+)", 1)
    said = symbols.where("kind = 'method'").select("id", "file_id", "name", "start_line", F.explode("annotations").alias("text")).withColumn("mark", bare("text"))
    wanted = said.where(F.col("mark").isin(*GRAPHQL_ROOTS, *DECORATOR_ROOTS, "SchemaMapping"))
    given = refs.where("kind = 'annotation'").withColumn("mark", bare("name")).where(F.col("mark").isin(*GRAPHQL_ROOTS, "SchemaMapping"))
    given = given.groupBy(F.col("from_symbol_id").alias("id"), "mark").agg(F.max_by(F.struct("arg_types", "str_args"), "id").alias("args")).select("id", "mark", "args.*")
    rows = wanted.join(given, ["id", "mark"], "left")
    named = lambda names, at: F.when(_raw().isNotNull(), F.try_element_at(attribute_strings(_raw(), names), F.lit(1))).otherwise(F.try_element_at("str_args", F.lit(at)))
    option = F.nullif(F.regexp_extract("text", r"\bname\s*:\s*['\"`]([^'\"`]+)['\"`]", 1), F.lit(""))
    key = F.when(F.col("mark") == "SchemaMapping", schema_coordinate(named(["typeName"], 1), named(["field", "value"], 2)))
    for mark, root in GRAPHQL_ROOTS.items():
        key = F.when(F.col("mark") == mark, schema_coordinate(F.lit(root), F.coalesce(named(["value", "name", "field"], 1), F.col("name")))).otherwise(key)
    key = F.when(F.col("mark").isin(*DECORATOR_ROOTS), schema_coordinate(F.col("mark"), F.coalesce(option, F.col("name")))).otherwise(key)
    return _declared(symbols, "graphql-field", "consumer").unionByName(_answering(rows, key, F.concat(F.lit("@"), "mark", F.lit(" -> "), key)))


def grpc(facts: Facts) -> DataFrame:
    """Methods of services, and those of types that extend a service's generated base; these spell the first letter small.

    A server's method takes the declared spelling, or its own where no service is declared, so servers alone have endpoints too.
    """
    symbols = facts["symbols"]
    declared = _declared(symbols, "rpc-method", "consumer")
    generated = facts["imports"].where(F.col("fqn").endswith("ImplBase")).groupBy("file_id").agg(F.collect_set("fqn").alias("imported"))  # of one file
    types = types_view(symbols).where("size(supertypes) > 0").join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id").join(generated, "file_id", "left")
    imported = F.coalesce("imported", F.array().cast("array<string>"))
    service = F.try_element_at(F.filter(F.transform("supertypes", lambda s: service_of_base(s, imported)), lambda s: s.isNotNull()), F.lit(1))
    served = types.select(F.col("fqn").alias("container_fqn"), service.alias("service")).where("service is not null")
    methods = symbols.where("kind = 'method'").join(served, "container_fqn")
    lowered = F.concat(F.lower(F.substring("name", 1, 1)), F.substring("name", 2, 1 << 30))
    spelled = symbols.where("kind = 'rpc-method'").groupBy(F.col("container_fqn").alias("service"), lowered.alias("name")).agg(F.min("name").alias("spelled"))
    rows = methods.join(spelled, ["service", "name"], "left")
    return declared.unionByName(_answering(rows, rpc_coordinate(F.col("service"), F.coalesce("spelled", "name")), F.concat("service", F.lit("ImplBase#"), "name")))


def mybatis(facts: Facts) -> DataFrame:
    """Statements of mapper files, and the methods of the types that these name."""
    symbols = facts["symbols"]
    made = _declared(symbols, "sql-statement", "provider")
    mapped = symbols.where("kind = 'sql-statement'").select("container_fqn").distinct()
    methods = symbols.where("kind = 'method'").join(mapped, "container_fqn", "left_semi")
    return made.unionByName(_answering(methods, F.concat("container_fqn", F.lit("#"), "name"), F.col("signature")).withColumn("role", F.lit("consumer")))


def migrations(scripts: DataFrame, symbols: DataFrame) -> DataFrame:
    """``path, table, symbol_id``: tables that migration scripts (``path, text``) touch and the types whose names they give."""
    touched = scripts.where(F.col("path").rlike(r"(^|/)[VR][^/]*__[^/]*\.sql$|(^|/)U[^/]*__[^/]*\.sql$")).select("path", F.explode(tables_touched(F.col("text"))).alias("table"))
    offered = touched.select("path", "table", F.explode(class_names("table")).alias("name"))
    types = symbols.where(F.col("kind").isin("class", "interface")).select("name", F.col("id").alias("symbol_id"))
    return offered.join(types, "name").select("path", "table", "symbol_id").distinct()


class Plugin(NamedTuple):
    endpoints: Callable[[Facts], DataFrame]
    edge_kind: str
    confidence: float


PLUGINS = {
    "http": Plugin(http, "calls-route", 0.8),
    "sqs": Plugin(sqs, "sends-to", 0.85),
    "kafka": Plugin(kafka, "sends-to", 0.85),
    "spring-event": Plugin(spring_event, "publishes-to", 0.8),
    "camel": Plugin(camel, "routes-to", 0.9),
    "graphql": Plugin(graphql, "implemented-by", 0.9),
    "grpc": Plugin(grpc, "implemented-by", 0.9),
    "mybatis": Plugin(mybatis, "implemented-by", 0.95),
}


def collected(facts: Facts, plugins: dict[str, Plugin] = PLUGINS, failures: dict[str, str] | None = None) -> DataFrame:
    """All plugins' endpoints. A plugin whose plan can't be built is left out, and its error is put into ``failures``; without one it is raised."""
    out = facts["refs"].sparkSession.createDataFrame([], "plugin string, file_id long, symbol_id long, role string, key string, line int, detail string")
    for name, plugin in plugins.items():
        try:
            out = out.unionByName(plugin.endpoints(facts).select(F.lit(name).alias("plugin"), *OUT))
        except Exception as e:
            if failures is None:
                raise
            failures[name] = f"{type(e).__name__}: {e}"
    return out


def wired(bindings: DataFrame, plugins: dict[str, Plugin] = PLUGINS) -> DataFrame:
    """Edges from every consumer to every provider of its key."""
    kind, confidence = F.lit("binds"), F.lit(0.9)
    for name, plugin in plugins.items():
        kind = F.when(F.col("plugin") == name, plugin.edge_kind).otherwise(kind)
        confidence = F.when(F.col("plugin") == name, plugin.confidence).otherwise(confidence)
    return endpoint_pairs(bindings, kind, confidence)
