"""Distributed sorting: Spark samples, deals by range and sorts within ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.storage import Stage


def range_sorted(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Sorted ranges: partition r holds the r-th range, in order. Equal keys share a partition."""
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def ranges(rows: DataFrame, parts: int, key: str) -> DataFrame:
    """(part, n, low, high) of the sorted ranges."""
    dealt = rows.repartitionByRange(parts, key).select(F.spark_partition_id().alias("part"), key)
    return dealt.groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))


def ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """Globally sorted."""
    return rows.orderBy(*keys)


#: Rows of one range, about.
RANGE_ROWS = 1_000_000


def positions(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` with ``position`` from 1 in the global order, without sorting everything in one task.

    Rows are dealt by range, without ``parts`` into as many as their number asks for; a partition's rows count on from
    the sum of those before it (one number a partition). Equal keys go by where the rows were read, so that they
    needn't share a partition.
    """
    if parts is None:
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = (*keys, "__tie")
    # written once: a second evaluation might sample other bounds
    dealt = Stage(tied.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), "ranges").df
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    upto = sizes.select(
        "__part", (F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).alias("__before")
    )
    place = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return (
        dealt.withColumn("__place", place)
        .join(F.broadcast(upto), "__part")  # as many rows as parts
        .withColumn("position", F.coalesce("__before", F.lit(0)) + F.col("__place"))
        .drop("__part", "__place", "__before", "__tie")
    )


def sorted_list(column: str | Column) -> Column:
    """An array column in ascending order."""
    return F.sort_array(column)
