"""Products of sparse matrices in coordinate form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, value) of the product of two (i, j, value) matrices; entries that no pair of entries makes are absent."""
    r = right.select(F.col("i").alias("k"), F.col("j").alias("to"), F.col("value").alias("r"))
    met = left.join(r, F.col("j") == F.col("k"))
    return met.groupBy("i", F.col("to").alias("j")).agg(F.sum(F.col("value") * F.col("r")).alias("value"))
