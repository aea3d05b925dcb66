"""Shortest paths by relaxation from a frontier, and breadth-first levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.plans.superstep import Result, VertexProgram, run


def program(source: int, weighted: bool = False, max_supersteps: int | None = None) -> VertexProgram:
    """Distances from ``source``: hops, or sums of edge weights. Unreachable vertices have null.

    Only vertices whose distance fell send on; any fall counts, however small. Paths have any number of edges: supersteps
    go on until no distance falls, unless ``max_supersteps`` are given. A cycle of negative weight is an error.
    """
    return VertexProgram(
        init=F.when(F.col("id") == source, F.lit(0.0)),
        init_active=F.col("id") == source,
        message=F.col("value") + (F.col("weight") if weighted else F.lit(1.0)),
        combine=F.min,
        apply=F.least("value", "combined"),
        frontier=True,
        tolerance=0.0,
        max_supersteps=max_supersteps,
    )


def shortest_paths(graph: Graph, source: int = 1, weighted: bool = False, max_supersteps: int | None = None) -> Result:
    return run(graph, program(source, weighted, max_supersteps))


def breadth_first(graph: Graph, source: int = 1, max_supersteps: int | None = None) -> Result:
    """Levels: the number of hops from the source."""
    return run(graph, program(source, False, max_supersteps))
