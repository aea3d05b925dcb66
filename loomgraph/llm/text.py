"""Word rules of the text operators, as Spark columns (native) and as Python functions (same results)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes that are no part of a word of the alphanumeric rule, once A-Z is lower case: they become spaces.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def alnum_words(lowered: Column) -> Column:
    """Array of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of text that is already lower case."""
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def alnum_normal(text: bytes) -> bytes:
    """The same words of a UTF-8 text, joined by single spaces."""
    return b" ".join(text.translate(_ALNUM).split())
