"""Quotation linking: conversations rebuilt as reply trees, without their quotes.

A line's quote level is the number of ``>`` marks before its text (blanks between them do not
count). A passage is a run of lines of one level without empty lines between. Passages are
normalised (A-Z in lower case, white space runs to one blank, trimmed) and hashed with SHA-256. A
quoted passage links to the first message of its conversation that says the passage at level 0,
if that message comes before. One that no message says whole is linked by its pieces, for quotes trimmed or wrapped anew: its
lines and sentences of at least ``PIECE_WORDS`` words, to the latest of the messages that first say one
of them. A message replies to the latest of the messages that it quotes;
without any it is the root of a thread. Messages sorted by (conv_id, root_turn, turn) are in reply
order: each thread together and every reply after what it replies to.

Everything is DataFrame operations. "First message that says it" is a partial aggregate, so a
conversation or a passage with a third of all rows is merged map-side, cut to what is quoted and then joined one row
to many over salted rows, never pair by pair; roots are found by pointer doubling over (conv_id, turn), whose
rounds are written to the shared folder, and no conversation is gathered in one task.

Null text is an empty message; rows with a null conv_id or turn are kept as roots without links.
Rows that repeat (conv_id, turn) are kept each; they share their replies and the root of the first
that replies to anything. Messages of any length are read whole. An empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import LOWER, UPPER, Scratch, dealt, repeated

PIECE_WORDS = 3
BLANKS = " \t\n\x0b\f\r"


def _lines() -> Column:
    """Array of structs: each line's quote level and its text without the marks. One character class at a time: lines of any number of marks are read without recursion."""
    return F.expr(r"transform(split(text, '\n', -1), l -> struct(length(translate(regexp_extract(l, '^[ \\t>]*', 0), ' \t', '')) as level, regexp_replace(l, '^[ \\t>]*>[ \\t]?', '') as line))")


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), "[\\x20\\x09-\\x0D]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, passage, pieces``: one row for each passage with a word, normalised, with its distinct lines and sentences."""
    lines = messages.select("conv_id", "turn", _lines().alias("ls"))
    # A line starts a run if its level differs from the line's before or that line has no text.
    marked = lines.select("conv_id", "turn", F.expr(r"transform(ls, x -> struct(x.level as level, x.line as line, x.line rlike '[^\\x20\\x09-\\x0D]' as full))").alias("ls"))
    starts = F.expr("filter(sequence(0, size(ls) - 1), i -> ls[i].full and (i = 0 or not ls[greatest(i, 1) - 1].full or ls[greatest(i, 1) - 1].level <> ls[i].level))")
    runs = marked.select("*", starts.alias("starts"))
    # Each run's lines are cut out before the rows part, so no row carries the whole message.
    cut = F.expr("transform(starts, (s, k) -> struct(ls[s].level as level, transform(filter(slice(ls, s + 1, if(k + 1 < size(starts), starts[least(k + 1, size(starts) - 1)], size(ls)) - s), x -> x.full), x -> x.line) as lines))")
    whole = runs.select("conv_id", "turn", F.explode(cut).alias("run")).select("conv_id", "turn", "run.level", "run.lines")
    joined = whole.select("conv_id", "turn", "level", _normal(F.array_join("lines", " ")).alias("passage"), F.transform("lines", _normal).alias("lines")).where("passage <> ''")
    sentences = F.split(F.regexp_replace("passage", "([.!?…]) ", "$1\n"), "\n")
    pieces = F.filter(F.array_distinct(F.concat("lines", sentences)), lambda x: F.size(F.split(x, " ")) >= PIECE_WORDS)
    return joined.select("conv_id", "turn", "level", "passage", pieces.alias("pieces"))


def unquoted(text: Column) -> Column:
    """The text's lines of level 0, white space trimmed at both ends."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike("^[ \\t]*>"))
    return F.btrim(F.array_join(kept, "\n"), F.lit(BLANKS))


def linked(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (without quotes), ``n_quotes, n_linked, parent_turn, root_turn, depth``."""
    scratch = Scratch(messages.sparkSession)
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    hashed = F.transform("pieces", lambda x: F.sha2(x, 256))
    said = passages(base).where("conv_id is not null and turn is not null").select("conv_id", "turn", "level", F.sha2("passage", 256).alias("h"), hashed.alias("hs"), F.monotonically_increasing_id().alias("q"))
    said = scratch.save(said)
    first, quotes = said.where("level = 0"), said.where("level > 0").select("q", "conv_id", "turn", "h", "hs")
    whole = scratch.save(_origins(quotes.select("q", "conv_id", "turn", "h"), first.select("conv_id", "turn", "h")))
    rest = quotes.join(whole.select("q"), "q", "left_anti").select("q", "conv_id", "turn", F.explode("hs").alias("h"))
    partly = _origins(rest, first.select("conv_id", "turn", F.explode("hs").alias("h")))
    origins = whole.unionByName(partly).groupBy("q").agg(F.max("origin").alias("origin"))
    found = quotes.select("q", "conv_id", "turn").join(origins, "q", "left")
    replies = scratch.save(found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.max("origin").alias("parent_turn")))
    roots = _roots(replies.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), scratch)
    out = base.join(replies, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        unquoted(F.col("text")).alias("text"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce("up", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def _origins(quotes: DataFrame, said: DataFrame) -> DataFrame:
    """``q, origin``: for each row of ``quotes`` (``q, conv_id, turn, h``) the first turn that says ``h``, if it comes before."""
    wanted = quotes.select("conv_id", "h").distinct()
    first = said.groupBy("conv_id", "h").agg(F.min("turn").alias("origin")).join(wanted, ["conv_id", "h"], "left_semi")
    return dealt(quotes, "q").join(repeated(first), ["conv_id", "h", "salt"]).where("origin < turn").select("q", "origin")


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling: ``up`` becomes the root and ``depth`` the steps to it, in log2(depth) joins."""
    now = scratch.save(links)
    while not now.isEmpty():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        met = now.join(above, ["conv_id", "up"], "left")
        after = scratch.save(met.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        scratch.drop(now)
        now = after
        if now.where("moved").isEmpty():
            break
    return now.select("conv_id", "turn", "up", "depth")
