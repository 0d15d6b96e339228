"""Ranked symbol search in one pass over the symbols: every tier is a condition, the best one is the score."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.names import has_phrase
from callweave.functions.predicates import is_generated


def _folded(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split_query(query: str) -> tuple[str, str | None]:
    """``Type#member`` and ``Type.member`` name two things, anything else one."""
    if "#" in query:
        return tuple(query.split("#")[:2])  # type: ignore[return-value]
    if re.fullmatch(r"[A-Za-z_$][\w$]*\.[A-Za-z_$][\w$]*", query):
        return tuple(query.split("."))  # type: ignore[return-value]
    return query, None


def scored(symbols: DataFrame, query: str, kinds: list[str] | None = None) -> DataFrame:
    """Located own symbols with ``score``: 100 Type#member, 95 whole name, 90 name, 70 ending, 50 part, 30 words; 1 less if generated."""
    q = (query or "").strip()
    if not q:
        return symbols.limit(0).withColumn("score", F.lit(0))
    left, right = split_query(q)
    fqn, name, low = _folded(F.coalesce("fqn", F.lit(""))), _folded(F.col("name")), F.lit(_fold(q))
    score = (
        F.when(fqn == low, 95)
        .when(name == low, 90)
        .when(F.endswith(fqn, low), 70)
        .when(F.contains(name, low), 50)
        .when(has_phrase("name", F.lit(q)) | has_phrase("fqn", F.lit(q)) | has_phrase("signature", F.lit(q)), 30)
    )
    if right:
        owner = (F.col("container_fqn") == left) | F.endswith(_folded(F.col("container_fqn")), F.lit("." + _fold(left)))
        score = F.when((F.col("name") == right) & owner, 100).otherwise(score)
    hits = symbols.withColumn("score", score - is_generated(F.col("modifiers")).cast("int")).where("score is not null")
    return hits.where(F.col("kind").isin(*kinds)) if kinds else hits


def search(symbols: DataFrame, query: str, limit: int = 20, kinds: list[str] | None = None) -> DataFrame:
    return scored(symbols, query, kinds).orderBy(F.desc("score"), F.coalesce("fqn", "name"), "id").limit(limit)


def best_match(symbols: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """The hits that share the best score within the first ten; more than one is an ambiguity to report."""
    top = search(symbols, name, limit)
    best = top.agg(F.max("score").alias("best"))
    return top.join(best, top["score"] == best["best"]).drop("best")


def ambiguity_note(name: str, ties: list[tuple[str, str, int]]) -> str:
    """Text that names a tie: (fqn, path, line) each."""
    return "\n".join([f'"{name}" is ambiguous: {len(ties)} symbols match', *(f"  {f}  ({p}:{n})" for f, p, n in ties), "", "Give a qualified name, such as Type#member."])
