"""URL rules, with block decisions carried over redirect and canonical-link aliases.

A rule is a host and a path prefix; it fits its host and every subdomain, and the longest rule
string that fits decides. A url that no rule fits takes the verdict of its aliases: the connected
component over redirect (meta refresh) and canonical-link edges found in the pages. An explicit
allow anywhere in the component takes precedence over blocks, which take precedence over the
default, allow. A rule of a url's own is never overridden.

Every canonical and refresh tag of a page counts; addresses have their character references read.
A node is a url without scheme, default port, fragment and dot segments, host in lower case, so two pages of one url are one
node; link targets outside the table are nodes too and are judged by the rules. All of it is
DataFrame operations. Only rows that carry a link reach the component search.

Rules are a list, or a table of any size with columns ``verdict`` and ``rule``. They meet the distinct (host, path) of the
urls by equality: a host's suffixes with the rules' hosts, then the path's prefixes, of the lengths that such a host's rules have,
with the rules' paths. What is found meets the pages again in joins whose rows are dealt by a salt, so one url may have
a third of all rows. Of rules of one length an allow goes before a block, then the greater string.

Null urls and urls without ``://`` have empty host and path, no node and no rule: they are allowed.
Null html has no links; html of any length is searched whole. Repeated rows are judged alike; other columns are left out;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.common import Scratch, ascii_lower, dealt, repeated
from callweave.llm.components import components

#: (verdict, host/path prefix)
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Redirect tags, link tags, the rel of those that have ``canonical`` among its words, and the addresses inside.
REFRESH_TAG = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
LINK_TAG = r"(?is)(<link\b[^>]*>)"
CANONICAL_REL = r"(?is)\brel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: Character references by name that addresses have; others are numbers or stay.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "sol": "/", "colon": ":", "quest": "?", "num": "#", "equals": "=", "period": ".", "percnt": "%", "commat": "@", "lowbar": "_", "comma": ",", "semi": ";", "plus": "+"}


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The alias key; null without a host."""
    h = host(url)
    scheme = F.lower(F.substring_index(url, "://", 1))
    h = F.when(scheme == "http", F.regexp_replace(h, ":80$", "")).when(scheme == "https", F.regexp_replace(h, ":443$", "")).otherwise(h)
    return F.when(h != "", F.concat(h, _undotted(path(url)), F.regexp_extract(_rest(url), "^[^?#]*([^#]*)", 1)))


def _undotted(p: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(p, "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.expr("cast(array() as array<string>)"), step)
    ended = F.when(p.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(p)


def _unescaped(s: Column) -> Column:
    """``s`` with its HTML character references read, each once."""

    def read(x: Column) -> Column:
        name = F.regexp_extract(x, "^&([A-Za-z]+);$", 1)
        number = F.regexp_extract(x, "^&#([0-9]{1,7});$", 1)
        hexed = F.regexp_extract(x, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        point = F.when(number != "", number.cast("bigint")).when(hexed != "", F.conv(hexed, 16, 10).cast("bigint"))
        known = F.create_map(*[F.lit(v) for pair in ENTITIES.items() for v in pair])
        char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF), char).otherwise(F.coalesce(F.try_element_at(known, name), x))

    pieces = F.regexp_extract_all(s, F.lit("(&#?[0-9A-Za-z]+;|[^&]+|&)"), F.lit(1))
    return F.when(F.instr(s, "&") > 0, F.array_join(F.transform(pieces, read), "")).otherwise(s)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """``rule_host, rule_path, rule, verdict``, one row for each host and path."""
    if not isinstance(rules, DataFrame):
        items = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
        rules = spark.range(1).select(F.inline(F.array(*items)) if items else F.inline(F.expr("cast(array() as array<struct<verdict: string, rule: string>>)")))
    split = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("rule_host"), F.concat(F.lit("/"), F.regexp_extract("rule", "^[^/]*/(.*)$", 1)).alias("rule_path"))
    return split.groupBy("rule_host", "rule_path").agg(F.max("rule").alias("rule"), F.min("verdict").alias("verdict"))  # allow before block


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, best`` (rule and verdict) of the distinct ``(host, path)`` that a rule fits."""
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))  # no more than the longest rule has characters
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = urls.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    tried = each.join(lengths, "rule_host").select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("path"))
    fits = tried.withColumn("rule_path", F.substring(F.col("path"), F.lit(1), F.col("n"))).join(rules, ["rule_host", "rule_path"])
    return fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "allow", "rule")).alias("best"))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as seen from ``url``: absolute, of the same scheme, of the same host, of the same path, or beside the page."""
    scheme = F.regexp_extract(url, "^([^:/?#]*)://", 1)
    top = F.concat(scheme, F.lit("://"), host(url))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(top, link))
        .when(F.startswith(link, F.lit("?")) | F.startswith(link, F.lit("#")), F.concat(top, path(url), link))
        .otherwise(F.concat(top, F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), "[^/]*$", ""), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: the nodes of each page and of all its canonical and redirect targets.

    Each step on a link is a ``transform`` of its own: put into one another, the steps repeat what they read until the plan holds
    millions of characters, and the driver's memory goes to planning, whatever the input."""
    url = F.col("url")
    canonical = F.transform(F.filter(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(1)), lambda t: t.rlike(CANONICAL_REL)), lambda t: F.regexp_extract(t, HREF, 1))
    refresh = F.transform(F.regexp_extract_all("html", F.lit(REFRESH_TAG), F.lit(1)), lambda t: F.regexp_extract(t, REFRESH_URL, 1))
    read = F.transform(F.filter(F.concat(canonical, refresh), lambda x: x != ""), _unescaped)
    targets = F.transform(F.transform(read, lambda x: _absolute(x, url)), node)
    return pages.select(node(url).alias("a"), F.explode(targets).alias("b")).where("a is not null and b is not null")


def judged(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and component_verdict (what the aliases say, if anything)."""
    spark = pages.sparkSession
    scratch, rules = Scratch(spark), rule_table(spark, rules)
    pages = pages.select("page_id", "url", "html")
    members = scratch.save(components(scratch.save(link_edges(pages)), scratch))
    own = members.select("*", F.regexp_extract("node", "^([^/?#]*)", 1).alias("host"), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1).alias("path"))
    told = own.join(ruled(own, rules), ["host", "path"], "left").select("node", "component", F.col("best.verdict").alias("v"))
    votes = told.groupBy("component").agg(F.coalesce(F.bool_or(F.col("v") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.bool_or(F.col("v") == "block"), F.lit(False)).alias("blocked"))
    said = dealt(members, "node").join(repeated(votes), ["component", "salt"]).select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("component_verdict"))
    plain = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), node(F.col("url")).alias("node"))
    joined = dealt(plain, "page_id").join(repeated(ruled(plain, rules)), ["host", "path", "salt"], "left").join(repeated(said), ["node", "salt"], "left")
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "component_verdict", F.lit("allow")).alias("verdict"), "component_verdict")
