"""Minimum spanning forests by Boruvka's rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.storage import Stage


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst, weight), src < dst: the forest's edges; direction is ignored, equal weights go by the ends' ids.

    Each round, every component takes its lightest edge to another one; components at least halve in number.
    """
    least, most = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    links = edges.filter("src <> dst").select(least, most, "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    left = Stage(links.select("src", "dst", "weight", F.col("src").alias("a"), F.col("dst").alias("b")), "msf-edges")
    taken: Stage | None = None
    for _ in range(max_rounds):
        if left.df.isEmpty():
            break
        edge = F.struct("weight", "src", "dst", "a", "b")
        sides = left.df.select(F.col("a").alias("c"), edge.alias("e")).union(left.df.select(F.col("b"), edge))
        chosen = Stage(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "msf-chosen")
        new = chosen.df.select("src", "dst", "weight")
        now = Stage(new if taken is None else taken.df.unionByName(new), "msf-taken")
        names = connected_components(chosen.df.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        a, b = names.withColumnsRenamed({"id": "ia", "component": "ca"}), names.withColumnsRenamed({"id": "ib", "component": "cb"})
        # every component that has an edge left took one, so each end has a new name
        merged = left.df.join(a, F.col("a") == F.col("ia")).join(b, F.col("b") == F.col("ib")).filter("ca <> cb")
        rest = Stage(merged.select("src", "dst", "weight", F.col("ca").alias("a"), F.col("cb").alias("b")), "msf-edges")
        for s in (left, chosen, *([taken] if taken else [])):
            s.drop()
        left, taken = rest, now
    return taken.df if taken else links
