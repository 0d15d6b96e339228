"""Source text written from the star tables: one Java file for each part, so that extraction and resolution run on tables too.

Parts of one block of four form an inheritance chain up to the block's last, which declares the members that the others inherit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.extract import facts, raw_facts
from callweave.operators import endpoints
from callweave.operators.resolve import Java, Ruby
from callweave.plans.scratch import Scratch
from callweave.plans.star import Facts

#: ``k`` is the part, ``m`` the last part, ``root`` the class at the top of k's chain.
CLASSES = """
    select k, m, least(k + (4 - k % 4) % 4, m) as root, concat('pkg.n', cast(k % 5 as string), '.C', cast(k as string)) as fqn, concat('src/n', cast(k % 5 as string), '/C', cast(k as string), '.java') as path
    from (select cast(p_partkey as bigint) as k, max(cast(p_partkey as bigint)) over () as m from {part}) p"""

TEXT = f"""
    select path, 'java' as lang, concat('package pkg.n', k % 5, ';\\n',
        case when k < m then concat('import pkg.n', (k + 1) % 5, '.C', k + 1, ';\\n') else '' end,
        'public class C', k, case when k % 4 <> 0 and k < m then concat(' extends C', k + 1) else '' end, ' {{\\n',
        case when k = root then '  public int size() {{ return 1; }}\\n  public void put(int n) {{ }}\\n  public void put(String s) {{ }}\\n' else '' end,
        '  private void go', k, '(int at) {{\\n    size();\\n    String t = "a";\\n    put("x");\\n    put(at);\\n    put(t);\\n    missing', k % 3, '();\\n    t.trim();\\n',
        case when k < m then concat('    new C', k + 1, '();\\n') else '' end, '  }}\\n}}\\n') as text
    from ({CLASSES}) c"""


#: Interfaces of blocks of eight customers: ``k`` extends the ``j`` after it in its block that a rule picks, in an order that isn't theirs.
EXTENDS = """
    select a.c_custkey as k, b.c_custkey as j, (b.c_custkey * 5 + a.c_custkey) % 7 as turn
    from {customer} a join {customer} b on a.c_custkey div 8 = b.c_custkey div 8 and b.c_custkey > a.c_custkey
    where (a.c_custkey * 3 + b.c_custkey * 5 + a.c_nationkey) % 3 > 0"""
#: Every interface declares one default method of four and calls all four.
DIAMONDS = f"""
    select concat('dia/D', k, '.java') as path, 'java' as lang, concat('package dia;\n\ninterface D', k, coalesce(concat(' extends ', above), ''), ' {{\n  default void m', k % 4, '() {{ }}\n  default void go', k, '() {{\n    m0();\n    m1();\n    m2();\n    m3();\n  }}\n}}\n') as text
    from (select cast(c_custkey as bigint) as k from {{customer}}) c
    left join (select k, array_join(transform(array_sort(collect_list(struct(turn, j))), x -> concat('D', x.j)), ', ') as above from ({EXTENDS}) e group by k) using (k)"""

#: A Ruby class for each part ``k``, every third a record: an association with the next, and a method that calls on it, on a parameter named after ``j``, and on a new ``j``.
RUBY = """
    select concat('app/c', k, '.rb') as path, 'ruby' as lang, concat('class C', k, case when k % 3 = 0 then ' < ApplicationRecord' else '' end, '\n',
        case when k < m then concat('  has_one :c', k + 1) else '' end, '\n  def name', k, '\n  end\n', case when k % 4 = 0 then '  def method_missing(name)\n  end\n' else '\n\n' end,
        '  def go', k, case when j <> k + 1 then concat('(c', j, ')') else '' end, '\n    name', k, '\n', case when k < m then concat('    c', k + 1, '.name', k + 1) else '' end, '\n', case when j <> k + 1 then concat('    c', j, '.name', j) else '' end,
        '\n    top', k % 3, '\n    x = C', j, '.new\n    x.lost', k, '(1)\n  end\nend\n', case when k <= 3 then concat('def top', k % 3, '\nend\n') else '' end) as text
    from (select *, k * 7 % m + 1 as j from (select cast(p_partkey as bigint) as k, max(cast(p_partkey as bigint)) over () as m from {part}) p) q"""


def spread(sql: str) -> str:
    """``sql`` with the last part as a value of its own: a window over the whole table would put every part into one task."""
    return sql.replace("max(cast(p_partkey as bigint)) over ()", "(select max(cast(p_partkey as bigint)) from {part})")


class Rendered:
    """The facts of the rendered files, their edges and calls without one."""

    TEXT = TEXT

    def __init__(self, f: Facts) -> None:
        scratch = Scratch(f.spark, merge=True)
        table = lambda name: f"(select /*+ merge(t) */ * from parquet.`{f.sf_dir}/{name}.parquet` t)"
        text = f.spark.sql(spread(self.TEXT).replace("{part}", table("part")).replace("{customer}", table("customer")))
        # a small table is read by few tasks, and its extraction takes far longer than reading it
        text = text.repartition(4 * f.spark.sparkContext.defaultParallelism, "path")
        files = scratch.save(text.selectExpr("*", "sha1(text) as hash", "size(split(text, '\\n', -1)) as lines"))
        self.facts = facts(files, scratch.save(raw_facts(files)))

    @cached_property
    def java(self) -> Java:
        return Java(*[self.facts[n] for n in ("files", "symbols", "imports", "locals", "refs")])

    def resolved(self) -> tuple[DataFrame, DataFrame]:
        return self.java.resolved()


class Diamonds(Rendered):
    """Interfaces that reach an ancestor over several paths."""

    TEXT = DIAMONDS


class RenderedRuby(Rendered):
    """Ruby classes whose calls take every fallback."""

    TEXT = RUBY

    def resolved(self) -> tuple[DataFrame, DataFrame]:
        return Ruby(*[self.facts[n] for n in ("symbols", "locals", "refs")]).resolved()


def _word(container: str) -> Column:
    return F.regexp_replace(container, r"\W", "")


class Schemas:
    """A GraphQL and a service file for each container, and the tables' symbols as what answers them.

    A schema declares its container's methods whose names' length isn't 2 modulo 3, in order. A GraphQL file has a description, a type with a
    comment, then an extended root type whose fields take two lines each; a service file a service in a comment, then rpcs of three
    lines each, with options in braces. Methods answer by annotation or decorator; types extend generated bases in both spellings.
    """

    def __init__(self, f: Facts) -> None:
        scratch = Scratch(f.spark)
        own = f.symbols.where("kind = 'method' and container_fqn is not null and length(name) % 3 <> 2").groupBy(_word("container_fqn").alias("word")).agg(F.array_sort(F.collect_set("name")).alias("names"))  # the tables hold few names
        each = lambda make: F.array_join(F.transform("names", make), "")
        field = lambda x: F.concat(F.lit("  "), x, F.lit("(first: Int = 5,\n    after: String): ["), F.col("word"), F.lit('!]! @auth(role: "x: y")\n'))
        rpc = lambda x: F.concat(F.lit("  rpc "), F.upper(F.substring(x, 1, 1)), F.substring(x, 2, F.lit(1 << 30)), F.lit(' (Q) returns (R) {\n    option (google.api.http) = { get: "/v1" };\n  }\n'))
        graphql = F.concat(F.lit('"""\nText: no field\n"""\ntype '), "word", F.lit(" implements Node { # none: here\n  id: ID!\n}\nextend type Query {\n"), each(field), F.lit("}\n"))
        proto = F.concat(F.lit("// service Old { rpc Gone (A) returns (B); }\nservice "), "word", F.lit(" {\n"), each(rpc), F.lit("}\n"))
        texts = [own.select(F.concat("word", F.lit(end)).alias("path"), F.lit(lang).alias("lang"), text.alias("text")) for end, lang, text in ((".graphqls", "graphql", graphql), (".proto", "proto", proto))]
        files = scratch.save(texts[0].unionByName(texts[1]).selectExpr("*", "sha1(text) as hash", "size(split(text, '\\n', -1)) as lines"))
        self.schema = facts(files, scratch.save(raw_facts(files)))["symbols"]
        option = F.concat(F.lit("@Query(() => [X], { name: '"), "name", F.when(F.expr("id % 2 = 0 or id % 7 = 0"), "_all").otherwise(""), F.lit("' })"))
        none = F.array().cast("array<string>")
        notes = F.when(F.col("kind") != "method", none).when(F.expr("id % 3 = 0"), F.array(F.lit("@QueryMapping"))).when(F.expr("id % 3 = 1"), F.array(F.lit("@Deprecated"), F.lit("@SchemaMapping"))).otherwise(F.array(option))
        base = F.concat(_word("fqn"), F.lit("ImplBase"))
        supers = F.when(F.expr("id % 8 = 0"), F.array(F.concat(_word("fqn"), F.lit("Grpc."), base))).when(F.expr("id % 8 = 4"), F.array(F.lit("Object"), base)).otherwise(none)
        answering = f.symbols.withColumns({"annotations": notes, "supertypes": supers})
        shared = ["id", "file_id", "name", "fqn", "kind", "container_fqn", "signature", "start_line", "annotations", "supertypes"]
        mapped = answering.where("kind = 'method' and id % 3 = 1")
        raw = F.concat(F.lit('field = "id", typeName = "'), _word("container_fqn"), F.lit('"'))
        refs = mapped.select("id", F.col("id").alias("from_symbol_id"), F.lit("@SchemaMapping").alias("name"), F.lit("annotation").alias("kind"), F.array(raw).alias("arg_types"), none.alias("str_args"))
        imports = answering.where("id % 12 = 4").select("file_id", F.concat(F.lit("gen."), _word("fqn"), F.lit("Grpc."), base).alias("fqn"))
        self.facts = {"symbols": self.schema.select(shared).unionByName(answering.select(shared)), "refs": refs, "imports": imports}

    def edges(self, plugin: str) -> DataFrame:
        """The plugin's edges, with the full names of their schema ends."""
        bound = endpoints.collected(self.facts, {plugin: endpoints.PLUGINS[plugin]})
        names = self.schema.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("from_fqn"), "container_fqn")
        return endpoints.wired(bound).join(names, "from_symbol_id").select("from_fqn", "container_fqn", "to_symbol_id", "kind", "confidence", "via", "line")
