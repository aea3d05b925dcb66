"""Part files of integers parted by white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_integers(spark: SparkSession, path: str) -> DataFrame:
    """(v): all integers of the files, repeated ones too; anything else is an error."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w"))
    return words.filter("w <> ''").select(F.col("w").cast("long").alias("v"))
