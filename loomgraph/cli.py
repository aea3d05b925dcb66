"""Command line: ``python -m loomgraph [algorithm] [edges]``."""

from __future__ import annotations

import argparse
import logging
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import Graph, GraphError
from loomgraph.operators.clusters import assigned, kmeans
from loomgraph.operators.components import connected_components
from loomgraph.operators.matrix import multiply
from loomgraph.operators.pagerank import pagerank
from loomgraph.operators.paths import breadth_first, shortest_paths
from loomgraph.operators.sorting import positions
from loomgraph.operators.spanning import spanning_forest
from loomgraph.operators.strong import strong_components
from loomgraph.operators.triangles import triangle_counts
from loomgraph.plans.superstep import MAX_SUPERSTEPS, TOLERANCE
from loomgraph.sources.edgelist import read_edge_list, read_edge_table
from loomgraph.sources.integers import read_integers
from loomgraph.sources.results import path_lines, write_result

ALGORITHMS = ("pagerank", "trianglecount", "sssp", "bfs", "components", "scc", "mst", "matrix", "kmeans", "sort")
#: What runs without arguments.
DEFAULT_ALGORITHM, DEFAULT_GRAPH, DEFAULT_SOURCE = "trianglecount", "graph/small.graph", 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph", description="Graph algorithms over edge lists and edge tables.")
    p.add_argument("algorithm", nargs="?", default=DEFAULT_ALGORITHM, choices=ALGORITHMS)
    p.add_argument("edges", nargs="?", default=DEFAULT_GRAPH, help="edge-list text, or a Parquet table: src, dst[, weight]; i, j, value (matrix: its square); id, features (kmeans). sort: text with integers")
    p.add_argument("--source", type=int, default=DEFAULT_SOURCE, help="start of sssp and bfs")
    p.add_argument("--weighted", action="store_true", help="sssp by the table's weights")
    p.add_argument("--tol", type=float, default=TOLERANCE)
    p.add_argument("--max-iter", type=int, default=MAX_SUPERSTEPS)
    p.add_argument("--dedupe", action="store_true", help="count parallel edges once")
    p.add_argument("--clusters", type=int, default=2, help="kmeans: as many centres, at first the points with the smallest ids")
    p.add_argument("--out", help="folder to write the result to; else it is printed")
    p.add_argument("--master", help="Spark master, if spark-submit doesn't set it")
    p.add_argument("-v", "--verbose", action="store_true", help="log each superstep")
    return p


def of_table(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The algorithms whose input is no graph."""
    if args.algorithm == "sort":
        return positions(read_integers(spark, args.edges), None, "v").select("position", "v")
    table = spark.read.parquet(args.edges)
    if args.algorithm == "matrix":
        return multiply(table, table)
    first = np.array([r["features"] for r in table.orderBy("id").limit(args.clusters).collect()])
    return assigned(table, kmeans(table, first, args.max_iter))


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.algorithm in ("matrix", "kmeans", "sort"):
        return of_table(spark, args)
    if args.edges.rstrip("/").endswith(".parquet"):
        columns = spark.read.parquet(args.edges).columns
        graph: Graph = read_edge_table(spark, args.edges, weight="weight" if "weight" in columns else None)
    else:
        graph = read_edge_list(spark, args.edges)
    if args.dedupe:
        graph = graph.deduplicated()
    match args.algorithm:
        case "pagerank":
            return pagerank(graph, tolerance=args.tol, max_supersteps=args.max_iter).vertices.select("id", "value")
        case "sssp":
            return path_lines(shortest_paths(graph, args.source, args.weighted, args.max_iter).vertices, args.source)
        case "bfs":
            return breadth_first(graph, args.source, args.max_iter).vertices.select("id", "value")
        case "trianglecount":
            return triangle_counts(graph).filter("triangles > 0").unionByName(
                triangle_counts(graph).agg(F.lit(None).cast("long").alias("id"), F.sum("triangles").alias("triangles"))
            )
        case "components":
            return graph.vertices.join(connected_components(graph.edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        case "scc":
            return strong_components(graph)
        case _:
            return spanning_forest(graph.edges)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(message)s")
    builder = SparkSession.builder.appName("loomgraph")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    try:
        found = result(spark, args)
        if args.out:
            write_result(found, args.out)
        else:
            for row in found.orderBy(found.columns[0]).toLocalIterator():
                print(row["line"] if "line" in found.columns else "\t".join(map(str, row)))
    except (GraphError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
