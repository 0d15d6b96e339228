"""Which files are new, changed, gone or as they were, and a stream that keeps stored facts in step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def compared(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """``path, status`` from ``path, hash`` of both sides."""
    a, b = stored.select("path", F.col("hash").alias("old")), listed.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def without_files(facts: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Facts after files (``file_id``) are deleted: theirs go, and edges go that lose either end."""
    out = {n: df.join(gone, df["id" if n == "files" else "file_id"] == gone["file_id"], "left_anti") for n, df in facts.items() if n in ("files", "symbols", "refs", "imports", "locals", "bindings")}
    alive = out["symbols"].select(F.col("id").alias("alive"))
    if "edges" in facts:
        edges = facts["edges"]
        edges = edges.join(alive, edges["from_symbol_id"] == alive["alive"], "left_semi")
        out["edges"] = edges.join(alive, edges["to_symbol_id"] == alive["alive"], "left_semi")
    if "unresolved" in facts:
        refs = out["refs"].select(F.col("id").alias("alive"))
        out["unresolved"] = facts["unresolved"].join(refs, facts["unresolved"]["ref_id"] == refs["alive"], "left_semi")
    return out


def watch(spark: SparkSession, folder: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "400 milliseconds", once: bool = False) -> StreamingQuery:
    """Streams listings (parquet with ``schema``) from ``folder`` and hands each micro-batch to ``apply``.

    The trigger interval is the debounce; a batch that runs long takes what came meanwhile in one go. A file source doesn't see
    deletions, so ``apply`` finds them by ``compared``. One query a checkpoint: a second writer is refused by Spark.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
