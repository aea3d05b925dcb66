"""Connected components by alternating stars; of few links, in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.storage import Stage

#: So many distinct links at most, by count, are joined by one task: rounds of stars would cost more in tasks than in work.
FEW = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) of every end of ``edges`` (src, dst), taken as undirected; component is the smallest id reachable.

    Edges lead from a greater to a lesser id. In a large star, each vertex hands its least neighbour to the greater
    ones; in a small star, its least neighbour to the lesser ones. Both keep what is connected; many links within one
    group soon become one link to its least vertex, so that later rounds are light. When nothing changes, every vertex
    is linked with the least of its component only. Rounds grow with the logarithm of the number of vertices.
    """
    high, low = F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    first = edges.select(high, low).distinct()
    alone = Stage(first.filter("u = v").select("u"), "cc-loops")
    held, mark = watched(first.filter("u <> v"))
    if mark[0] <= FEW:
        return held.df.union(alone.df.select("u", F.col("u").alias("v"))).coalesce(1).mapInArrow(joined, "id long, component long")
    for _ in range(max_rounds):
        was = mark
        for star in (large_star, small_star):
            new, mark = watched(star(held.df))
            held.drop()
            held = new
        if mark == was:
            break
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    linked = held.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    own = held.df.select("v").union(alone.df.join(held.df.select("u"), "u", "left_anti")).distinct()
    return linked.unionByName(own.select(F.col("v").alias("id"), F.col("v").alias("component")))


def watched(links: DataFrame) -> tuple[Stage, tuple]:
    """The links (u, v) as a table, with their number and the sum of their hashes, by which a change is seen."""
    seen = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
    held = Stage(links.observe(seen, F.count("*").alias("n"), total), "cc-links")
    return held, (seen.get["n"], seen.get["total"])


def large_star(links: DataFrame) -> DataFrame:
    """Each vertex's greater neighbours, linked with its least neighbour or itself, whichever is less."""
    both = links.select(F.col("v").alias("id"), F.col("v").alias("near")).union(links.select("u", "v"))
    least = both.groupBy("id").agg(F.min("near").alias("least"))
    return links.join(least, F.col("v") == F.col("id")).select("u", F.col("least").alias("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Each vertex and its lesser neighbours, linked with the least of them."""
    least = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("least"))
    met = links.join(least, F.col("u") == F.col("id"))
    moved = met.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")
    return least.select(F.col("id").alias("u"), F.col("least").alias("v")).union(moved).distinct()


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the ends of all links (u, v) of the batches: roots move to the least root they are linked with."""
    u, v = (np.concatenate(c) for c in zip(*[(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches], (np.zeros(0, np.int64),) * 2))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = place[: u.size], place[u.size :], np.arange(ids.size)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    for i in range(0, ids.size, 65536):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 65536]), pa.array(ids[root[i : i + 65536]])], names=["id", "component"])
