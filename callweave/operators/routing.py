"""HTTP routes: who serves each key, who calls it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def endpoints(bindings: DataFrame, symbols: DataFrame, files: DataFrame, match: str | None = None) -> DataFrame:
    """Route endpoints with file and symbol, as far as there is one; ``match`` looks in key, symbol and detail."""
    at = bindings.where("plugin = 'http'").select("id", "file_id", "symbol_id", "role", "key", "line", "detail").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    rows = at.join(symbols.select(F.col("id").alias("symbol_id"), "fqn"), "symbol_id", "left")
    if match:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "key", F.coalesce("fqn", F.lit("")), F.coalesce("detail", F.lit("")))), F.lit(match.lower())))
    return rows


def without_shadows(rows: DataFrame) -> DataFrame:
    """Drops a provider of ``ANY path`` where a real verb is known for the path."""
    any_ = F.col("key").startswith("ANY ")
    known = rows.where(~any_).select(F.substring_index("key", " ", -1).alias("route")).distinct()
    shadows = rows.where(any_ & (F.col("role") == "provider")).withColumn("route", F.substring_index("key", " ", -1)).join(known, "route", "left_semi").select("id")
    return rows.join(shadows, "id", "left_anti")


def routes(bindings: DataFrame, symbols: DataFrame, files: DataFrame, match: str | None = None) -> DataFrame:
    rows = without_shadows(endpoints(bindings, symbols, files, match))
    made = F.col("role") == "provider"
    return rows.groupBy("key").agg(F.count(F.when(made, 1)).alias("providers"), F.count(F.when(~made, 1)).alias("consumers"))
