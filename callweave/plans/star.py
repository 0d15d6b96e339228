"""Star-schema tables read as fact tables, so that every operator runs on plain tables too.

The mappings are SQL that any engine reads: ``{part}`` and the like stand for the tables. Lists are
``|``-separated there; ``Facts`` splits them. No edge and no binding names the symbols whose id is 5 modulo 15, and a
third of those have names of their own, so unreached code and rare names occur.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS = {
    "files": """
        select cast(s_suppkey as bigint) as id,
            concat(case when s_suppkey % 7 = 0 then 'test/' when s_suppkey % 11 = 0 then 'src/__tests__/' else 'lib/' end, 'n', cast(s_nationkey as string), '/', replace(s_name, '#', ''),
                case s_nationkey % 5 when 0 then '.java' when 1 then '.rb' when 2 then '.ts' when 3 then '.tsx' else '.js' end) as path,
            case s_nationkey % 5 when 0 then 'java' when 1 then 'ruby' when 2 then 'typescript' when 3 then 'tsx' else 'javascript' end as lang,
            concat('pkg.n', cast(s_nationkey as string)) as pkg, cast(100 + s_suppkey % 90 as int) as lines,
            case when s_nationkey % 6 = 5 then 1 else 0 end as external, case when s_nationkey % 6 = 5 then concat('dep', cast(s_nationkey as string)) end as owner
        from {supplier}""",
    "symbols": """
        select cast(p_partkey as bigint) as id, cast(p_partkey % (select count(*) from {supplier}) as bigint) as file_id, concat(replace(p_name, ' ', '_'), case when p_partkey % 45 = 5 then cast(p_partkey as string) else '' end) as name,
            case when p_partkey % 4 = 0 then concat(p_brand, '.T', cast(p_size % 10 as string)) when p_partkey % 97 = 0 then null else concat(p_brand, '.T', cast(p_size % 10 as string), '.', replace(p_name, ' ', '_')) end as fqn,
            case p_partkey % 8 when 0 then 'class' when 4 then 'interface' when 1 then 'method' when 2 then 'function' when 3 then 'class_method' when 5 then 'method' when 6 then 'field' else 'constructor' end as kind,
            case when p_partkey % 4 = 0 then null else concat(p_brand, '.T', cast(p_size % 10 as string)) end as container_fqn,
            p_type as type_name, concat(p_name, '(', case when p_size % 9 = 0 then 'String... rest' when p_size % 9 = 1 then '*args' else p_type end, ')') as signature,
            cast(p_size % 4 as int) as arity, cast(p_size as int) as start_line, cast(p_size + p_partkey % 30 as int) as end_line,
            concat(case when p_partkey % 5 = 0 then 'private' when p_partkey % 5 = 1 then 'export' else 'public' end, case when p_partkey % 7 = 0 then '|generated' else '' end, case when p_partkey % 41 = 0 then '|abstract' else '' end) as modifiers_text,
            case when p_partkey % 9 = 0 then '@Bean' when p_partkey % 9 = 1 then 'Scheduled(cron)|Deprecated' when p_partkey % 9 = 2 then '@Deprecated' else '' end as annotations_text,
            case when p_partkey % 4 = 0 then concat(p_brand, '.T', cast((p_size + 1) % 10 as string), '|', p_type) else '' end as supertypes_text
        from {part}""",
    "raw_edges": """
        select cast(l_orderkey * 7 % (select count(*) from {part}) as bigint) as from_symbol_id, cast(l_partkey - case when l_partkey % 15 = 5 then 1 else 0 end as bigint) as to_symbol_id,
            case l_returnflag when 'A' then 'calls' when 'R' then 'instantiates' else case l_linestatus when 'O' then 'implements' else 'extends' end end as kind,
            round(1 - l_discount, 2) as confidence,
            case l_linenumber when 1 then 'direct' when 2 then 'constructor' when 3 then 'unique-name' when 4 then 'interface->impl' when 5 then 'binding:http' when 6 then 'name-convention' else 'declaration' end as via,
            case when l_linenumber = 7 then null else cast(l_quantity * 10 + l_linenumber as int) end as line,
            concat(lpad(cast(l_orderkey as string), 12, '0'), lpad(cast(l_suppkey as string), 12, '0'), lpad(cast(cast(round(l_extendedprice * 100) as bigint) as string), 14, '0'), lpad(cast(cast(round(l_tax * 100) as bigint) as string), 4, '0')) as seq
        from {lineitem}""",
    "refs": """
        select e.event_id as id, cast(e.user_id % (select count(*) from {supplier}) as bigint) as file_id, case when e.event_id % 17 = 0 then null else cast(e.event_id * 13 % (select count(*) from {part}) as bigint) end as from_symbol_id,
            concat(replace(p.p_name, ' ', '_'), case when p.p_partkey % 45 = 5 then cast(p.p_partkey as string) else '' end) as name, case when e.k % 3 = 0 then null else concat('r', cast(e.k % 5 as string)) end as receiver, cast(e.k % 5 as int) as arity,
            case when e.event_id % 4 = 3 then e.event_id - 1 when e.event_id % 4 = 2 then e.event_id - 1 end as receiver_ref_id, cast(e.event_id % 300 as int) as line,
            case e.event_type when 'signup' then 'new' when 'error' then 'annotation' else 'call' end as kind
        from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}) e join {part} p on p.p_partkey = e.k""",
    "unresolved": """
        select event_id as ref_id,
            case k % 8 when 0 then 'ambiguous-name' when 1 then 'complex-receiver-chain' when 2 then 'no-such-method-on:T' when 3 then 'unknown-method' when 4 then 'external:not-in-project' when 5 then 'external:not-reachable-from-scope' when 6 then 'external:jdk-runtime' else null end as reason,
            case when k % 8 in (4, 5, 6) then 1 when k % 8 = 7 and user_id % 2 = 0 then 1 else 0 end as external,
            case when k % 8 = 6 then 'jdk-runtime' when k % 8 = 7 and user_id % 2 = 0 then concat('lib', cast(user_id % 7 as string)) end as owner
        from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}) e""",
    "bindings": """
        select event_id as id, cast(user_id % (select count(*) from {supplier}) as bigint) as file_id, case when event_id % 13 = 0 then null else cast(n - case when n % 15 = 5 then 1 else 0 end as bigint) end as symbol_id,
            case user_id % 3 when 0 then 'http' when 1 then 'kafka' else 'sqs' end as plugin, case when event_type in ('purchase', 'signup') then 'provider' else 'consumer' end as role,
            case when user_id % 3 = 0 then concat(case k % 4 when 0 then 'ANY' when 1 then 'POST' else 'GET' end, ' /p/', cast(k - k % 2 as string)) else concat('topic-', cast(k as string)) end as key,
            cast(event_id % 300 as int) as line, props as detail, concat('repo', cast(user_id % 4 as string)) as repo_id
        from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k, event_id * 11 % (select count(*) from {part}) as n from {events}) e""",
    "imports": """
        select cast(c_custkey as bigint) as id, cast(c_custkey % (select count(*) from {supplier}) as bigint) as file_id,
            concat(case when c_nationkey % 2 = 0 then concat('Brand#', cast(1 + c_custkey % 25 as string), '.T', cast(c_nationkey % 10 as string)) else concat('org.', lower(c_mktsegment), '.n', cast(c_nationkey as string), '.X') end) as fqn,
            case when c_custkey % 10 = 0 then 1 else 0 end as is_wildcard, case when c_custkey % 7 = 0 then 1 else 0 end as is_static
        from {customer}""",
}

#: A mapper file for each container: a comment, then three lines for each of its methods' names whose length isn't 2 modulo 3, in order, and an update without end.
MAPPERS = """
    select container_fqn, min(id) as id, concat('<mapper namespace="', container_fqn, '">\n<!-- <select id="retired">\n -->\n', array_join(array_sort(collect_set(concat('<select id="', name, '">\n  select 1\n</select>\n'))), ''), '<update id="stray">\n</mapper>\n') as text
    from symbols where kind = 'method' and container_fqn is not null and length(name) % 3 <> 2 group by container_fqn"""

#: First writer wins among edges of one key; null lines are one value.
VIEWS["edges"] = f"""
        select from_symbol_id, to_symbol_id, kind, confidence, via, line from (
            select *, row_number() over (partition by from_symbol_id, to_symbol_id, kind, line order by seq) as rn from ({VIEWS["raw_edges"]}) r) k where rn = 1"""


def sql(name: str, **tables: str) -> str:
    return VIEWS[name].format(**{t: tables.get(t, t) for t in STAR})


def prelude(*names: str) -> str:
    """``with`` clauses for an engine that has the star tables as views."""
    return "with " + ",\n".join(f"{n} as ({sql(n)})" for n in names)


class Facts:
    """The fact tables of one star-schema folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def star(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        return self.spark.sql(sql(name, **{t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in STAR}))

    files = cached_property(lambda self: self._view("files"))
    raw_edges = cached_property(lambda self: self._view("raw_edges"))
    edges = cached_property(lambda self: self._view("edges"))
    refs = cached_property(lambda self: self._view("refs"))
    unresolved = cached_property(lambda self: self._view("unresolved"))
    bindings = cached_property(lambda self: self._view("bindings"))
    imports = cached_property(lambda self: self._view("imports"))

    @cached_property
    def mappers(self) -> DataFrame:
        return self.spark.sql(MAPPERS.replace("symbols", "{symbols}"), symbols=self.symbols)

    @cached_property
    def symbols(self) -> DataFrame:
        lists = {x: F.filter(F.split(f"{x}_text", "\\|"), lambda y: y != "") for x in ("modifiers", "annotations", "supertypes")}
        return self._view("symbols").withColumns(lists).drop(*[f"{x}_text" for x in lists])
