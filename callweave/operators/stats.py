"""Counts and shares: what is linked, what left the project, what was missed, and on which evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions.names import percent
from callweave.functions.predicates import GUESSED_VIA, evidence_class


def project_stats(files: DataFrame, symbols: DataFrame, types: DataFrame, edges: DataFrame, refs: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row of counts; files, symbols, types and calls are the project's own, and annotations are no calls."""
    own = files.where("external = 0").select(F.col("id").alias("file_id"))
    mine = symbols.join(own, "file_id", "left_semi")
    calls = refs.join(own, "file_id", "left_semi")
    counts = {
        "files": own,
        "symbols": mine,
        "types": types.join(mine.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi"),
        "edges": edges,
        "refs": calls.where("kind <> 'annotation'"),
        "unresolved": unresolved.join(calls.select(F.col("id").alias("ref_id")), "ref_id", "left_semi"),
        "external": unresolved.where("external = 1"),
    }
    one, *rest = (df.agg(F.count("*").alias(name)) for name, df in counts.items())
    for other in rest:  # single rows each
        one = one.join(other, F.lit(True))
    return one


def resolution(stats: DataFrame) -> DataFrame:
    """Linked, library and missed calls, and the share of in-project calls that are linked."""
    linked, inside = F.col("refs") - F.col("unresolved"), F.col("refs") - F.col("external")
    return stats.select("refs", linked.alias("linked"), F.col("external").alias("library"), (F.col("unresolved") - F.col("external")).alias("missed"), percent(linked, inside).alias("resolution_pct"), percent(F.col("external"), F.col("refs")).alias("library_pct"))


def files_by_language(files: DataFrame) -> DataFrame:
    return files.where("external = 0").groupBy("lang").agg(F.count("*").alias("n"))


def evidence(unresolved: DataFrame) -> DataFrame:
    """Library calls by the evidence that they are."""
    return unresolved.where("external = 1").groupBy(evidence_class(F.col("reason"), F.col("owner")).alias("evidence")).agg(F.count("*").alias("n"))


def guessed(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("via").isin(*GUESSED_VIA)).groupBy("via").agg(F.count("*").alias("n"))


def resolution_floor(stats: DataFrame, unresolved: DataFrame, edges: DataFrame) -> DataFrame:
    """The share if every assumption were wrong: assumed calls come back, guessed links go."""
    assumed = evidence(unresolved).where(F.contains("evidence", F.lit("assumed"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assumed"))
    links = guessed(edges).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("guessed"))
    row = stats.join(assumed, F.lit(True)).join(links, F.lit(True))  # single rows
    return row.select("assumed", "guessed", percent(F.col("refs") - F.col("unresolved") - F.col("guessed"), F.col("refs") - F.col("external") + F.col("assumed")).alias("floor_pct"))


def endpoint_counts(bindings: DataFrame) -> DataFrame:
    """Providers and consumers of each plugin."""
    return bindings.groupBy("plugin").pivot("role", ["provider", "consumer"]).agg(F.count("role")).select("plugin", F.coalesce("provider", F.lit(0)).alias("provider"), F.coalesce("consumer", F.lit(0)).alias("consumer"))


def wired(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("via").startswith("binding:")).groupBy(F.substring_index("via", ":", -1).alias("plugin")).agg(F.count("*").alias("wired"))


def dependencies(files: DataFrame) -> DataFrame:
    """Libraries whose declarations were read."""
    read = files.where("external = 1")
    return read.agg(F.countDistinct("owner").alias("libraries"), F.count("*").alias("files"), F.count(F.when(F.col("path").startswith("jvm:"), 1)).alias("jvm_types"))


def top_libraries(unresolved: DataFrame, limit: int = 10) -> DataFrame:
    return unresolved.where("external = 1 and owner is not null").groupBy("owner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner").limit(limit)


def miss_reasons(unresolved: DataFrame, limit: int = 6) -> DataFrame:
    return unresolved.where("external = 0").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("reason")).limit(limit)


def missed_names(unresolved: DataFrame, refs: DataFrame, limit: int = 10) -> DataFrame:
    met = unresolved.where("external = 0").join(refs.select(F.col("id").alias("ref_id"), "receiver", "name"), "ref_id")
    return met.groupBy("receiver", "name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("receiver"), "name").limit(limit)


def overview(stats_by_repo: DataFrame) -> DataFrame:
    """All repositories together: sums, and resolution weighted by symbols. Input: ``symbols, edges, resolution``."""
    weight = F.sum(F.col("resolution") * F.col("symbols")) / F.greatest(F.sum("symbols"), F.lit(1))
    return stats_by_repo.agg(F.count("*").alias("repos"), F.sum("symbols").alias("symbols"), F.sum("edges").alias("edges"), F.round(weight, 1).alias("resolution"))


def import_fingerprint(imports: DataFrame) -> DataFrame:
    """SHA-1 over each file's sorted distinct imports: dependencies are read again only when it changes."""
    return imports.select("file_id", "fqn").distinct().groupBy("file_id").agg(F.sha1(F.array_join(F.array_sort(F.collect_list("fqn")), "\n")).alias("fingerprint"))


def unique_names(symbols: DataFrame) -> DataFrame:
    """Names declared once, with the symbol they mean: the pool for links by name."""
    return symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")
