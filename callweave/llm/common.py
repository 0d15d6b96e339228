"""What the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.plans.scratch import Scratch, shared_dir

__all__ = ["SPACE", "Scratch", "ascii_lower", "dealt", "repeated", "shared_dir", "table"]

#: How many ways the rows of a key are dealt.
SALTS = 8

#: The white space of the contracts: blank and the control characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, unlike ``lower``."""
    return F.translate(c, UPPER, LOWER)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with a salt by a hash of ``by``, so that those of one key spread over ``SALTS`` tasks."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def repeated(keys: DataFrame) -> DataFrame:
    """``keys``, one row a key, once for each salt."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
