"""Views of results as text, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import path_text


def path_lines(distances: DataFrame, source: int) -> DataFrame:
    """(id, line): ``path_len`` lines of shortest paths (id, value)."""
    return distances.select("id", path_text(source, F.col("id"), F.col("value")).alias("line"))


def write_result(result: DataFrame, path: str, kind: str = "parquet") -> None:
    result.write.format(kind).option("header", "true").save(path)
