"""Names: inflection, packages, modules, search text. All native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _str(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capital_first(c: Column | str) -> Column:
    """First letter upper-cased, the tail as it is (``initcap`` would lower it)."""
    c = _str(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def lower_first(c: Column | str) -> Column:
    c = _str(c)
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def camelize(c: Column | str) -> Column:
    """``line_items`` to ``LineItems``."""
    return F.array_join(F.transform(F.filter(F.split(_str(c), "_"), lambda x: x != ""), capital_first), "")


# The endings by which the plural and singular of a table's name are told apart.


def singularize(c: Column | str) -> Column:
    c = _str(c)
    return (
        F.when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y"))
        .when(c.rlike("(ch|sh|ss|x|z)es$"), F.regexp_replace(c, "es$", ""))
        .when(c.rlike("s$") & ~c.rlike("(ss|us|is)$"), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )


def classify(c: Column | str) -> Column:
    return camelize(singularize(c))


def candidate_models(table: Column | str) -> Column:
    """Class names that a table may belong to, the likeliest first."""
    t = _str(table)
    forms = F.array_distinct(F.array(singularize(t), F.regexp_replace(t, "es$", ""), F.regexp_replace(t, "s$", ""), t))
    return F.transform(F.filter(forms, lambda x: x != ""), camelize)


def class_names(table: Column | str) -> Column:
    """Names that a migration's table joins with."""
    t = _str(table)
    return F.array_distinct(F.array(classify(t), classify(singularize(t)), t, singularize(t)))


def simple_name(fqn: Column | str) -> Column:
    return F.element_at(F.split(_str(fqn), r"\."), -1)


def owner_package(fqn: Column | str, segments: int = 3) -> Column:
    """The first segments of an import, which name its library."""
    return F.array_join(F.slice(F.split(_str(fqn), r"\."), 1, segments), ".")


def module_path(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_str(path), r"\.d\.(ts|mts|cts)$", ""), r"\.(tsx?|jsx?|mts|cts|mjs|cjs)$", "")


def package_of(specifier: Column | str) -> Column:
    """``@scope/name/sub`` to ``@scope/name``, ``pkg/sub`` to ``pkg``; null for relative ones."""
    s = _str(specifier)
    return F.when((s == "") | s.startswith("."), None).when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))


#: The languages and the extensions that name them.
EXTENSIONS = {
    "java": (".java",),
    "ruby": (".rb", ".rake"),
    "typescript": (".ts", ".mts", ".cts"),
    "tsx": (".tsx",),
    "javascript": (".js", ".mjs", ".cjs", ".jsx"),
}


def language(path: Column | str) -> Column:
    """By extension, in any case; null is no source."""
    ext = F.lower(F.regexp_extract(_str(path), r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for lang, known in EXTENSIONS.items():
        out = F.when(ext.isin(*known), lang).otherwise(out)
    return out


#: Files that declare what sources implement.
DECLARING = {"graphql": (".graphql", ".graphqls", ".gql"), "proto": (".proto",), "xml": (".xml",)}


def declaring(path: Column | str) -> Column:
    """The kind of schema file that a path names; null is none."""
    ext = F.lower(F.regexp_extract(_str(path), r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, known in DECLARING.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


def like_escaped(c: Column | str) -> Column:
    """Text with LIKE's wildcards made literal."""
    return F.regexp_replace(_str(c), r"([\\%_])", r"\\$1")


def tokens(c: Column | str) -> Column:
    """Search words: runs of letters and digits, lower-cased; an underscore separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(_str(c), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def has_phrase(c: Column | str, phrase: Column) -> Column:
    """The phrase's words occur side by side in this one column; an empty phrase never does."""
    padded = lambda x: F.concat(F.lit(" "), F.array_join(tokens(x), " "), F.lit(" "))
    return (F.size(tokens(phrase)) > 0) & F.contains(padded(c), padded(phrase))


def bean_forms(name: Column | str) -> Column:
    """A name and, for a bean accessor, its property in both spellings."""
    n = _str(name)
    bare = F.regexp_extract(n, "^(?:get|is|set|has)([A-Z].*)$", 1)
    return F.when(bare == "", F.array(n)).otherwise(F.array(n, bare, lower_first(bare)))


def annotation_name(c: Column) -> Column:
    """``@Bean(name)`` to ``Bean``."""
    return F.substring_index(F.regexp_replace(c, "^@", ""), "(", 1)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def percent(a: Column, b: Column) -> Column:
    """One decimal; 0 of nothing."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b * 100, 1))


def clamp(raw: Column, default: int, low: int, high: int) -> Column:
    """A number from text, cut to a range; what is no number gives the default."""
    n = F.try_to_number(F.trim(raw), F.lit("S999999999999")).cast("long")
    return F.when(n.isNull(), F.lit(default).cast("long")).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high)).cast("long"))
