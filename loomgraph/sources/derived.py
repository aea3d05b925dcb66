"""Graphs made of order tables: parts that follow each other (plain, priced, and a sparse one), parts ordered together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.model import Graph


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def next_line(spark: SparkSession, sf_dir: str) -> Graph:
    """Distinct (part of a line, part of the order's next line), without loops."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = lines(spark, sf_dir).select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return Graph.from_edges(pairs.filter("dst is not null and src <> dst").distinct())


def ordered_together(spark: SparkSession, sf_dir: str) -> Graph:
    """Distinct pairs of parts of one order, both ways."""
    # an order's parts are one row, and pairs are made once, not each way
    held = lines(spark, sf_dir).filter("l_orderkey is not null").select("l_orderkey", F.col("l_partkey").cast("long").alias("p")).repartition("l_orderkey")
    orders = held.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p")).alias("parts"))
    firsts = orders.select("parts", F.posexplode("parts").alias("at", "a"))
    pairs = firsts.select("a", F.explode(F.slice("parts", F.col("at") + 2, F.size("parts"))).alias("b"))
    return Graph.from_pairs(pairs.repartition("a").distinct())


def priced(spark: SparkSession, sf_dir: str, above: float | None = None) -> Graph:
    """Next lines, weighted by the least price of the first one; with ``above``, only if both quantities exceed it."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = lines(spark, sf_dir).select(
        F.col("l_partkey").alias("src"),
        F.lead("l_partkey").over(order).alias("dst"),
        F.col("l_quantity").alias("q"),
        F.lead("l_quantity").over(order).alias("next_q"),
        F.col("l_extendedprice").alias("price"),
    )
    kept = pairs.filter("dst is not null and src <> dst")
    if above is not None:
        kept = kept.filter((F.col("q") > above) & (F.col("next_q") > above))
    return Graph.from_edges(kept.groupBy("src", "dst").agg(F.min("price").alias("weight")))


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    """Priced next lines of which both have a quantity above 40: many components, deep paths."""
    return priced(spark, sf_dir, 40)
