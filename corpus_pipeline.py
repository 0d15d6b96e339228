"""The corpus pipeline: toxicity, quality rules, n-gram Jaccard join, best-fit packing.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
A stage's result is written as Parquet to the shared folder and reread as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import ngram_join, packing, quality, toxicity
from callweave.llm.common import Scratch, table
from callweave.llm.queries import tokenizer_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents among ``docs``; those at or over the threshold go."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the least doc_id. Five words a shingle, similarity 0.8."""
    return ngram_join.keep(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]

#: A fitted classifier and a packing heuristic have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
