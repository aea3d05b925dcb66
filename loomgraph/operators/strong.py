"""Strongly connected components by forward colouring and backward search, with trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.storage import Stage

#: Hops in one job: plans stay small, and few jobs are needed for deep graphs.
HOPS = 3


def strong_components(graph: Graph, max_rounds: int = 1000) -> DataFrame:
    """(id, component) of every vertex; component is the smallest id of its strong component.

    A round first trims vertices without edges in or out, which are components of their own. Then each vertex learns
    the largest id that reaches it (its colour); walking back from the vertex with that id, within the colour, finds its
    strong component. What is found goes, and the next round works on the rest.
    """
    edges = Stage(graph.edges.filter("src <> dst").select("src", "dst").distinct(), "scc-edges")
    found: list[DataFrame] = []
    bare = graph.vertices.join(ends(edges.df), "id", "left_anti").select("id", F.col("id").alias("component"))
    found.append(Stage(bare, "scc-found").df)
    for _ in range(max_rounds):
        edges, alone = trimmed(edges)
        found += alone
        if edges.df.isEmpty():
            break
        colours = coloured(edges.df)
        members = reached_back(edges.df, colours.df)
        named = members.df.groupBy("colour").agg(F.min("id").alias("component"))
        found.append(Stage(members.df.join(named, "colour").select("id", "component"), "scc-found").df)
        gone = members.df.select("id")
        rest = without(edges.df, gone)
        # vertices that lost all their edges are components of their own, unless they are found
        after = Stage(rest, "scc-edges")
        bare = ends(edges.df).join(gone, "id", "left_anti").join(ends(after.df), "id", "left_anti")
        found.append(Stage(bare.select("id", F.col("id").alias("component")), "scc-found").df)
        for s in (edges, colours, members):
            s.drop()
        edges = after
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    return kept.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def trimmed(edges: Stage) -> tuple[Stage, list[DataFrame]]:
    """Edges among vertices that have some in and some out, and the vertices that went; two steps in one job."""
    alone = []
    while True:
        now = edges.df
        for _ in range(2):
            inner = now.select(F.col("src").alias("id")).distinct().join(now.select(F.col("dst").alias("id")), "id", "left_semi")
            now = now.join(inner.withColumnRenamed("id", "src"), "src", "left_semi")
            now = now.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
        rest = Stage(now, "scc-edges")
        if rest.df.count() == edges.df.count():
            rest.drop()
            return edges, alone
        bare = ends(edges.df).join(ends(rest.df), "id", "left_anti")
        alone.append(Stage(bare.select("id", F.col("id").alias("component")), "scc-found").df)
        edges.drop()
        edges = rest


def coloured(edges: DataFrame) -> Stage:
    """(id, colour): the largest id that reaches each vertex."""
    held = Stage(ends(edges).select("id", F.col("id").alias("colour")), "scc-colours")
    while True:
        now = held.df.withColumn("was", F.col("colour"))
        for _ in range(HOPS):
            got = edges.join(now, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("colour").alias("got"))
            now = now.join(got, F.col("id") == F.col("dst"), "left").select(
                "id", F.greatest("colour", F.coalesce("got", "colour")).alias("colour"), "was"
            )
        new = Stage(now, "scc-colours")
        done = new.df.filter("colour <> was").isEmpty()
        held.drop()
        held = new
        if done:
            return held


def reached_back(edges: DataFrame, colours: DataFrame) -> Stage:
    """(id, colour): the vertices of each colour that reach the vertex whose id is the colour."""
    c = colours.select("id", "colour")
    inner = edges.join(c.withColumnsRenamed({"id": "src", "colour": "cs"}), "src").join(c.withColumnsRenamed({"id": "dst", "colour": "cd"}), "dst")
    inner = Stage(inner.filter("cs = cd").select("src", "dst", F.col("cs").alias("colour")), "scc-inner")
    held = Stage(c.filter("id = colour"), "scc-members")
    while True:
        now = held.df
        for _ in range(HOPS):
            more = inner.df.join(now.select(F.col("id").alias("dst"), F.col("colour").alias("k")), "dst").select(F.col("src").alias("id"), "colour")
            now = now.unionByName(more).distinct()
        new = Stage(now, "scc-members")
        grown = new.df.count() > held.df.count()
        held.drop()
        held = new
        if not grown:
            inner.drop()
            return held
