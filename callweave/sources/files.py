"""Source trees: discovery, ignore rules, admission, hashes, words of templates.

Trees are read with Spark's ``binaryFile`` source, so any file system that Spark reads will do and
the listing is distributed; nothing shells out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.names import declaring, language
from callweave.sources.ignores import contents, listed, tracked, trees
from callweave.sources.ignores import rules as ignore_rules

MAX_CHARS, PACKED_CHARS, PACKED_PER_LINE, NUL_WITHIN = 2 * 1024 * 1024, 20 * 1024, 1000, 8000


def admission(text: Column) -> Column:
    """``ok``, or why a text is no source: too large, binary, or packed into few long lines."""
    n = F.length(text)
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (
        F.when(n > MAX_CHARS, "too-large")
        .when(F.instr(F.substring(text, 1, NUL_WITHIN), "\0") > 0, "binary")
        .when((n > PACKED_CHARS) & (n / lines > PACKED_PER_LINE), "packed")
        .otherwise("ok")
    )


def ignored(path: Column, rules: list[str]) -> Column:
    """Ignore rules in order, the last that fits decides, ``!`` takes back; a rule without a slash fits any part.

    ``*`` stays within a part, ``**`` doesn't, a trailing slash means folders, a leading one the root.
    """
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        body = rule[1:] if back else rule
        folder = body.endswith("/")
        body = body.strip("/") if "/" not in body.strip("/") and not body.startswith("/") else "/" + body.strip("/")
        anchored = body.startswith("/")
        pattern, i = "", 0
        body = body.lstrip("/")
        while i < len(body):
            if body.startswith("**/", i):
                pattern, i = pattern + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                pattern, i = pattern + ".*", i + 2
            elif body[i] == "*":
                pattern, i = pattern + "[^/]*", i + 1
            elif body[i] == "?":
                pattern, i = pattern + "[^/]", i + 1
            else:
                pattern, i = pattern + ("\\" + body[i] if not body[i].isalnum() and body[i] not in "_/" else body[i]), i + 1
        full = ("^" if anchored else "(?:^|.*/)") + pattern + ("/.*" if folder else "(?:/.*)?") + "$"
        out = F.when(path.rlike(full), F.lit(not back)).otherwise(out)
    return out


def _relative(path: Column, root: str) -> Column:
    bare = F.regexp_replace(path, "^[a-z0-9]+:/*", "/")
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z0-9]+:/*", "/")
    return F.regexp_replace(F.substring(bare, F.length(base) + 2, F.lit(1 << 30)), "^/+", "")


def read_tree(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """``path, lang, text, hash, lines, admission`` of every source and schema file under ``root``, as git would list them; of XML only mappers.

    Ignore files of every folder and git's index decide (``sources.ignores``); ``rules`` are further ones of the root. Dot folders are passed over.
    """
    raw, ignore_files = trees(spark, root)
    kind = F.coalesce(language("path"), declaring("path"))
    named = raw.select(_relative(F.col("path"), root).alias("path"), "length", "content").where(kind.isNotNull() & ~ignored(F.col("path"), list(rules)))
    index = tracked(spark, root)
    texts = contents(spark, ignore_files).withColumn("path", _relative(F.col("path"), root)) if ignore_files else spark.createDataFrame([], "path string, content binary")
    source = listed(named.select("path"), ignore_rules(spark, root, texts), index).where("source").select("path")
    wanted = named.join(source, "path", "left_semi")
    # no character takes more than four octets: a longer file is too large without being read
    files = wanted.where(F.col("length") <= 4 * MAX_CHARS).select("path", "content")
    text = F.make_valid_utf8(F.col("content").cast("string"))  # octets that are no UTF-8 become replacement characters
    read = files.select("path", kind.alias("lang"), text.alias("text"), F.sha1("content").alias("hash")).select("*", (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), admission(F.col("text")).alias("admission")).where(r"lang <> 'xml' or text rlike '(?i)<\\s*mapper\\b'")
    left = wanted.where((F.col("length") > 4 * MAX_CHARS) & (kind != "xml")).select("path")
    null = lambda kind: F.lit(None).cast(kind)
    return read.unionByName(left.select("path", kind.alias("lang"), null("string").alias("text"), null("string").alias("hash"), null("int").alias("lines"), F.lit("too-large").alias("admission")))


def bare_words(texts: DataFrame) -> DataFrame:
    """Distinct identifiers of templates and configuration: what they name may be called."""
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1))).alias("word")).distinct()
