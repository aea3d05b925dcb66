"""Vertex programs as iterated joins and aggregations.

A program is a set of column expressions; Catalyst plans each superstep as: active vertices join edges on the source
(messages), aggregate by target (with partial aggregation before the shuffle), left join with the vertices (update).
Edges are dealt by source once and held, so a superstep shuffles vertices and combined messages only. New vertex states
are written to the shared folder, which cuts lineage and survives lost executors; the same job observes how many
vertices are active, the largest deviation and the number of messages, so a superstep is one job.
Where only a few messages are sent, only the vertices that get one are looked up and written; the others stay as they are.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Literal

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions import changed, deviation
from loomgraph.model import Graph
from loomgraph.storage import Stage

log = logging.getLogger("loomgraph")

#: Bytes that one message (target, source, value, weight) counts in the metrics.
MESSAGE_BYTES = 16
MAX_SUPERSTEPS = 120
TOLERANCE = 1e-4
#: A frontier that sends no more messages is broadcast, and only what it reaches is written; after so many tables they are merged.
FEW_MESSAGES = 100_000
MAX_TABLES = 32

METRICS = "step int, converged_pct double, residual double, least_residual double, messages long, bytes long, seconds double"


@dataclass(frozen=True)
class VertexProgram:
    """What a vertex does, as columns.

    ``init`` and ``init_active`` see id, out_degree and n (number of vertices). ``message`` and ``send`` see src, dst,
    value (the source's), weight, out_degree and n. ``combine`` aggregates ``message`` per target. ``apply`` sees id,
    value (old), combined, n, and is used where messages arrived; elsewhere the value stays. ``cover`` puts its result
    in place of the old value, ``accu`` adds it. With ``frontier``, only vertices that changed by more than ``tolerance``
    send. Without ``max_supersteps`` a run goes on until no vertex is active; more supersteps than vertices are an error.
    """

    init: Column
    message: Column
    combine: Callable[[Column], Column]
    apply: Column = field(default_factory=lambda: F.col("combined"))
    init_active: Column = field(default_factory=lambda: F.lit(True))
    send: Column = field(default_factory=lambda: F.lit(True))
    update: Literal["cover", "accu"] = "cover"
    frontier: bool = False
    tolerance: float = TOLERANCE
    max_supersteps: int | None = MAX_SUPERSTEPS


@dataclass(frozen=True)
class Result:
    """Final vertices (id, value, active), the metrics of each superstep, whether all vertices settled."""

    vertices: DataFrame
    metrics: list[dict]
    converged: bool

    def metrics_frame(self) -> DataFrame:
        columns = [c.split()[0] for c in METRICS.split(", ")]
        rows = [tuple(m[c] for c in columns) for m in self.metrics]
        return self.vertices.sparkSession.createDataFrame(rows, METRICS)


# ---- the operators of one superstep ---------------------------------------------------------------------------------


def initial(graph: Graph, program: VertexProgram, n: int) -> DataFrame:
    """(id, out_degree, value, active)."""
    numbered = graph.out_degrees().withColumn("n", F.lit(n))
    return numbered.select("id", "out_degree", program.init.cast("double").alias("value"), program.init_active.alias("active"))


def senders(vertices: DataFrame, frontier: bool = True) -> DataFrame:
    """The vertices that send: the active ones, or all."""
    return vertices.filter("active") if frontier else vertices


def messages(edges: DataFrame, sending: DataFrame) -> DataFrame:
    """(dst, src, value, weight, out_degree): one message for each edge of a sending vertex."""
    return edges.join(sending, F.col("src") == F.col("id")).select("dst", "src", "value", "weight", "out_degree")


def message_counts(sent: DataFrame, parts: int) -> DataFrame:
    """(part, n_messages) by the partition that owns the target."""
    return sent.groupBy(F.pmod("dst", F.lit(parts)).cast("int").alias("part")).agg(F.count("*").alias("n_messages"))


def upsert_predecessors(cache: DataFrame, sent: DataFrame) -> DataFrame:
    """Predecessor cache (dst, src, value, weight) after messages: known sources are overwritten, new ones added."""
    new = sent.select("dst", "src", "value", "weight")
    return cache.join(new, ["dst", "src"], "left_anti").select("dst", "src", "value", "weight").unionByName(new)


def received(sent: DataFrame, parts: int) -> DataFrame:
    """(part, src, value, targets): each source once at each partition that got messages from it, with its targets there."""
    here = sent.groupBy(F.pmod("dst", F.lit(parts)).cast("int").alias("part"), "src")
    return here.agg(F.first("value").alias("value"), F.collect_list(F.struct("dst", "weight")).alias("targets"))


def map_received(vertices: DataFrame) -> DataFrame:
    """(part, key, skey, value): a pair for each target of a received vertex, its value with the edge's weight added."""
    one = vertices.select("part", "src", "value", F.explode("targets").alias("t"))
    return one.select("part", F.col("t.dst").alias("key"), F.col("src").alias("skey"), (F.col("value") + F.col("t.weight")).alias("value"))


def touched(vertices: DataFrame, sent: DataFrame) -> DataFrame:
    """The vertices that got a message; the others needn't be computed."""
    return vertices.join(sent.select(F.col("dst").alias("id")), "id", "left_semi")


def materialised(graph: Graph, vertices: DataFrame) -> DataFrame:
    """One row a vertex: id, value, targets and sources as sorted arrays of structs."""
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("targets"))
    held = graph.edges.join(vertices.select(F.col("id").alias("src"), "value"), "src")
    into = held.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list(F.struct("src", "value", "weight"))).alias("sources"))
    return vertices.select("id", "value").join(out, "id", "left").join(into, "id", "left")


def combined(sent: DataFrame, program: VertexProgram, n: int) -> DataFrame:
    """(dst, combined): what each target gets."""
    seen = sent.withColumn("n", F.lit(n)).filter(program.send)
    return seen.groupBy("dst").agg(program.combine(program.message).alias("combined"))


def updated(vertices: DataFrame, got: DataFrame, program: VertexProgram, n: int) -> DataFrame:
    """Vertices with new values, whether they are active, and their deviation; untouched ids keep their value."""
    return applied(vertices.join(got, F.col("id") == F.col("dst"), "left"), program, n)


def applied(joined: DataFrame, program: VertexProgram, n: int) -> DataFrame:
    """New values of vertices that are joined with what they got (dst is null where that is nothing)."""
    joined = joined.withColumn("n", F.lit(n))
    reached = F.col("dst").isNotNull()
    fresh = program.apply if program.update == "cover" else F.coalesce("value", F.lit(0.0)) + program.apply
    moved = joined.withColumn("new", F.when(reached, fresh.cast("double")).otherwise(F.col("value")))
    active = changed(F.col("value"), F.col("new"), program.tolerance)
    return moved.select(
        "id", "out_degree", F.col("new").alias("value"), active.alias("active"), deviation(F.col("value"), F.col("new")).alias("deviation")
    )


def superstep(edges: DataFrame, vertices: DataFrame, program: VertexProgram, n: int) -> DataFrame:
    """One superstep as a plan, without an action."""
    sent = messages(edges, senders(vertices, program.frontier))
    return updated(vertices, combined(sent, program, n), program, n)


# ---- the loop -------------------------------------------------------------------------------------------------------


class States:
    """Vertex states: a table of all vertices, and the rows that each superstep since has touched."""

    def __init__(self, every: Stage):
        self.tables = [every]

    def frontier(self) -> DataFrame:
        return self.tables[-1].df.filter("active")

    def versions(self) -> DataFrame:
        """(id, out_degree, value, active, version) with the states of touched vertices before."""
        each = [t.df.select("id", "out_degree", "value", "active", F.lit(k).alias("version")) for k, t in enumerate(self.tables)]
        return reduce(DataFrame.unionByName, each)

    def merged(self) -> DataFrame:
        """All vertices, of one table from now on; active are those that the last superstep left so."""
        if len(self.tables) > 1:
            last = F.max_by(F.struct("out_degree", "value", "active", "version"), "version").alias("s")
            latest = self.versions().groupBy("id").agg(last).select("id", "s.*")
            active = F.col("active") & (F.col("version") == len(self.tables) - 1)
            self.replace(Stage(latest.select("id", "out_degree", "value", active.alias("active")), "vertices"))
        return self.tables[0].df

    def replace(self, every: Stage) -> None:
        for t in self.tables:
            t.drop()
        self.tables = [every]

    def touched(self, edges: DataFrame, program: VertexProgram, n: int) -> DataFrame:
        """A superstep of a small frontier: the new states of the vertices that get messages."""
        got = combined(messages(edges, F.broadcast(self.frontier())), program, n)
        near = self.versions().join(F.broadcast(got), F.col("id") == F.col("dst"))
        latest = near.groupBy("id", "dst").agg(F.max_by(F.struct("out_degree", "value"), "version").alias("s"), F.first("combined").alias("combined"))
        return applied(latest.select("id", "dst", "s.*", "combined"), program, n)


def run(graph: Graph, program: VertexProgram) -> Result:
    """Supersteps until no vertex is active or ``max_supersteps`` are done."""
    began = time.monotonic()
    held_graph = graph.partitioned()
    n = held_graph.vertices.count()
    states = States(Stage(initial(held_graph, program, n), "vertices"))
    every = held_graph.edges.count() if not program.frontier else None
    metrics: list[dict] = []
    sending = every
    if program.frontier:
        sending = states.merged().agg(F.coalesce(F.sum(F.when(F.col("active"), F.col("out_degree"))), F.lit(0))).first()[0]
    converged, least = False, float("inf")
    for step in range(1, (n + 1 if program.max_supersteps is None else program.max_supersteps) + 1):
        seen = Observation()
        few = program.frontier and sending <= FEW_MESSAGES
        if not few or len(states.tables) == MAX_TABLES:
            states.merged()
        plan = states.touched(held_graph.edges, program, n) if few else superstep(held_graph.edges, states.merged(), program, n)
        watched = plan.observe(
            seen,
            F.count_if("active").alias("active"),
            F.max("deviation").alias("residual"),
            F.sum(F.when(F.col("active"), F.col("out_degree"))).alias("next"),
        )
        new = Stage(watched, "vertices")
        got = seen.get
        if few:
            states.tables.append(new)
        else:
            states.replace(new)
        least = min(least, got["residual"] or 0.0)
        metrics.append(
            {
                "step": step,
                "converged_pct": 100.0 * (1 - got["active"] / n) if n else 100.0,
                "residual": float(got["residual"] or 0.0),
                "least_residual": float(least),
                "messages": int(sending),
                "bytes": int(sending) * MESSAGE_BYTES,
                "seconds": time.monotonic() - began,
            }
        )
        began = time.monotonic()
        log.info("superstep %(step)d: %(converged_pct).2f %% settled, residual %(residual)g, %(messages)d messages, %(seconds).3f s", metrics[-1])
        if not got["active"]:
            converged = True
            break
        sending = every if every is not None else (got["next"] or 0)
    if program.max_supersteps is None and not converged:
        raise RuntimeError(f"values still change after {n} supersteps: a cycle goes on changing them")
    vertices = states.merged()
    held_graph.edges.unpersist()
    return Result(vertices.select("id", "value", "active"), metrics, converged)


def totals(result: Result) -> dict:
    """Supersteps, messages, bytes and seconds of a run."""
    return {
        "supersteps": len(result.metrics),
        "messages": sum(m["messages"] for m in result.metrics),
        "bytes": sum(m["bytes"] for m in result.metrics),
        "seconds": sum(m["seconds"] for m in result.metrics),
    }


# ---- programs in Python ---------------------------------------------------------------------------------------------


def map_pairs(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Any number of (key, skey, value, svalue) rows for each batch of rows: the escape hatch for maps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield work(batch)

    return rows.mapInPandas(run, "key long, skey long, value double, svalue array<long>")


def reduce_pairs(pairs: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], by: list[str]) -> DataFrame:
    """One row (key, value) for each group of pairs: the escape hatch for reductions that no aggregate expresses.

    A group is held in one task's memory; for sums, minima and the like use an aggregate, which combines first.
    """
    return pairs.groupBy(*by).applyInPandas(work, "key long, value double")
