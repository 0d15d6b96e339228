"""Quality rules whose cutoffs are quantiles of the documents' own language and source.

Every document's measures are whole numbers. Their quantiles come from a mergeable sketch: a
log-linear histogram whose bucket is the number itself below 64 and its six leading bits
above, so that any value is known to 1/32 and a sketch has some hundreds of buckets at most.
Sketches of (language, source) merge into those of a language and of all documents, which
stand in where a group has fewer than ``min_group`` documents. A document fails the adaptive
rules when a measure lies beyond the fence of its group: ``tail + spread * (tail - q50) + STEP``, where ``tail`` is an upper
quantile of the group, so that a measure which most of a group hasn't at all is judged too. Symbols and
capitals take the upper decile, as what has too many is no more than that; repeated lines and windows, which good texts
have now and then, the last percentile. A fence is at most
``ROOF`` times the fence of the group's language, and a language's at most ``ROOF`` times that of all documents,
so that a source mostly of junk doesn't set its own standard. ``STEP`` is what rounding to thousandths and buckets can make of a difference.

Everything is DataFrame operations. The sketch is a partial aggregate, so a source with a
third of all rows is merged map-side, and the thresholds (one row a group) meet the measures in
a plain equi-join, broadcast or split by Spark as their size has it.

Null text counts as no words (base rules fail); null language and source are groups of their
own; repeated rows are judged alike; an empty table gives an empty one. Whole texts are measured, of any length: a
row's words and windows stand in memory at once. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import SPACE, Scratch

WORD = f"[^{SPACE}]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: For each measure, itself in thousandths, the tail quantile in thousandths and the spread in quarters.
FENCES = {"symbols": (900, 8), "duplicates": (990, 2), "repeats": (990, 2), "capitals": (900, 8)}
STEP, ROOF = 5, 2
MIN_GROUP, MIN_WORDS, MAX_REPEAT_PERCENT = 50, 20, 30
WINDOW = 8


def measured(docs: DataFrame, keys: list[Column]) -> DataFrame:
    """``keys``, ``lang``, ``source`` and the measures of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.expr(f"filter(split(text, '[{SPACE}]'), x -> x <> '')".replace("\\", "\\\\"))
    lines = F.expr(f"filter(split(text, '\\n', -1), x -> x rlike '[^{SPACE}]')".replace("\\", "\\\\"))
    one = docs.select(*keys, "lang", "source", text.alias("text"))
    two = one.select(
        *one.columns[:-1],
        ws.alias("ws"),
        lines.alias("lines"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", "\\P{Lu}+", "")).cast("long").alias("n_capitals"),
    )
    passed = [c for c in two.columns if c not in ("ws", "lines")]
    three = two.select(
        *passed,
        F.size("ws").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"if(size(ws) > {WINDOW}, transform(sequence(1, size(ws) - {WINDOW - 1}), i -> xxhash64(slice(ws, i, {WINDOW}))), cast(array() as array<bigint>))").alias("hs"),
    )
    passed = [c for c in three.columns if c != "hs"]
    # Windows found again, only where there are any: sorted by (hash, place), each stands beside an equal one.
    four = three.select(*passed, F.expr("if(size(array_distinct(hs)) < size(hs), array_sort(transform(hs, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))").alias("at"))
    five = four.select(*passed, F.expr("array_sort(transform(filter(at, (x, j) -> (j > 0 and at[greatest(j, 1) - 1].h = x.h) or (j + 1 < size(at) and at[least(j + 1, size(at) - 1)].h = x.h)), x -> x.i))").alias("at"))
    return five.select(*passed, F.expr(f"aggregate(transform(at, (p, j) -> if(j + 1 < size(at), least({WINDOW}, at[least(j + 1, size(at) - 1)] - p), {WINDOW})), 0L, (s, x) -> s + x)").alias("n_repeat_words"))


def _thousandths(part: str, whole: str) -> Column:
    return F.expr(f"if({whole} > 0, (1000 * {part}) div {whole}, 0L)")


def bucket(v: Column) -> Column:
    """The lower end of v's bucket: v with all but its six leading bits cleared."""
    bits = F.length(F.bin(v))
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, bits - 6), bits - 6))


def thresholds(values: DataFrame, fences: dict[str, tuple[int, int]], min_group: int, scratch: Scratch) -> DataFrame:
    """One row a (lang, source): the highest value of each measure that passes."""
    names = list(fences)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(F.col(n)).alias("b")) for n in names]))
    cells = values.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.b").agg(F.count("*").alias("n"))
    cells = scratch.save(cells)
    levels, spreads = (" ".join(f"when '{n}' then {v[i]}" for n, v in fences.items()) for i in (0, 1))
    sql = f"""
        with levels as (
            select 2 as level, lang, source, measure, b, n from {{cells}}
            union all select 1, lang, null, measure, b, sum(n) from {{cells}} group by lang, measure, b
            union all select 0, null, null, measure, b, sum(n) from {{cells}} group by measure, b
        ), ranked as (
            select *, sum(n) over (partition by level, lang, source, measure order by b rows unbounded preceding) as upto,
                sum(n) over (partition by level, lang, source, measure) as total
            from levels
        ), fences as (
            select level, lang, source, measure, max(total) as total,
                min(case when 2 * upto >= total then b end) as q50, min(case when 1000 * upto >= total * case measure {levels} end then b end) as tail
            from ranked group by level, lang, source, measure
        ), tops as (
            select *, tail + ((tail - q50) * case measure {spreads} end) div 4 + {STEP} as top from fences
        )
        , languages as (
            select l.lang, l.measure, case when l.total >= {min_group} then least(l.top, {ROOF} * a.top) else a.top end as top
            from tops l join tops a on a.level = 0 and l.measure = a.measure where l.level = 1
        )
        select g.lang, g.source, {", ".join(f"max(case when g.measure = '{n}' then case when g.total >= {min_group} then least(g.top, {ROOF} * l.top) else l.top end end) as top_{n}" for n in names)}
        from tops g join languages l on g.lang <=> l.lang and g.measure = l.measure
        where g.level = 2 group by g.lang, g.source"""
    return values.sparkSession.sql(sql, cells=cells)


def judged(docs: DataFrame, keys: list[Column], min_group: int = MIN_GROUP, fences: dict[str, tuple[int, int]] = FENCES) -> DataFrame:
    """The measures of ``docs`` with ``base_failed`` and ``kept``; one row for each of docs."""
    scratch = Scratch(docs.sparkSession)
    base = measured(docs, keys)
    shares = {
        "symbols": _thousandths("n_symbols", "word_chars"),
        "duplicates": _thousandths("n_dup_lines", "n_lines"),
        "repeats": _thousandths("n_repeat_words", "n_words"),
        "capitals": _thousandths("n_capitals", "word_chars"),
    }
    values = scratch.save(base.select("*", *[c.alias(n) for n, c in shares.items()]))
    tops = thresholds(values, fences, min_group, scratch).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"top_{n}" for n in shares])
    joined = values.join(tops, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for n in shares:
        within = within & (F.col(n) <= F.col(f"top_{n}"))
    return joined.drop("t_lang", "t_source").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)


def rejected(docs: DataFrame) -> DataFrame:
    """``(doc_id, h)``, h the text's hash, of the rows that fail."""
    return judged(docs, [F.col("doc_id"), F.xxhash64("text").alias("h")]).where(~F.col("kept")).select("doc_id", "h").distinct()


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are."""
    bad = rejected(docs).select(F.col("doc_id").alias("__doc_id"), F.col("h").alias("__h"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__doc_id"]) & (F.xxhash64(docs["text"]) == bad["__h"]), "left_anti")
