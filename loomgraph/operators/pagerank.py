"""PageRank by synchronous iteration."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.plans.superstep import MAX_SUPERSTEPS, TOLERANCE, Result, VertexProgram, run

DAMPING, INITIAL = 0.5, 1.0


def program(damping: float = DAMPING, initial: float = INITIAL, tolerance: float = TOLERANCE, max_supersteps: int = MAX_SUPERSTEPS) -> VertexProgram:
    """``value = damping * sum(value / out-degree of predecessors) + (1 - damping) / n``.

    Vertices start at ``initial``; those without predecessors keep it. Vertices without targets send nothing.
    """
    return VertexProgram(
        init=F.lit(initial),
        message=F.col("value") / F.col("out_degree"),
        combine=F.sum,
        apply=damping * F.col("combined") + (1 - damping) / F.col("n"),
        tolerance=tolerance,
        max_supersteps=max_supersteps,
    )


def pagerank(graph: Graph, **options) -> Result:
    return run(graph, program(**options))
