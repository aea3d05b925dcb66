"""Edge-list text.

The first two lines that are neither blank nor comments (``#``) are the numbers of vertices and of directed edges; each
further one holds a source and a target, parted by anything but digits. What follows on a line is ignored. Lines need
no order. Ids count from 1, or from 0 if the smallest source is 0; then 1 is added to all. Every id from 1 to the number
of vertices is a vertex, with or without edges.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import Graph, GraphError

_EDGE = r"^\s*(-?\d+)[^0-9]+(\d+)"


def data_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, place): lines that carry data, with their place in the files' order."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no such edge list: {path}") from e
        raise
    marked = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    text = F.trim(F.regexp_replace("value", r"[\t\r]", " "))
    return marked.filter((text != "") & ~text.startswith("#"))


def header(lines: DataFrame) -> tuple[int, int, int]:
    """Numbers of vertices and edges, and the place of the header's last line."""
    first = lines.orderBy("file", "place").limit(2).collect()
    try:
        return int(first[0]["value"].split()[0]), int(first[1]["value"].split()[0]), first[1]["place"]
    except (IndexError, ValueError) as e:
        raise GraphError("an edge list starts with the numbers of vertices and of edges") from e


def read_edge_list(spark: SparkSession, path: str, auto_one_based: bool = True, check: bool = True) -> Graph:
    """The graph of an edge-list file (or of a folder whose first file in name order starts with the header)."""
    lines = data_lines(spark, path)
    n_vertices, n_edges, last = header(lines)
    first_file = lines.agg(F.min("file")).first()[0]
    body = lines.filter((F.col("file") != first_file) | (F.col("place") > last))
    parsed = body.select(
        F.regexp_extract("value", _EDGE, 1).try_cast("long").alias("src"),
        F.regexp_extract("value", _EDGE, 2).try_cast("long").alias("dst"),
    )
    found = parsed.agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("bad"),
        F.min("src").alias("least_src"),
        F.min(F.least("src", "dst")).alias("least"),
        F.max(F.greatest("src", "dst")).alias("most"),
    ).first()
    shift = 1 if auto_one_based and found["least_src"] == 0 else 0
    if check:
        if found["bad"]:
            raise GraphError(f"{found['bad']} lines hold no edge")
        if found["lines"] != n_edges:
            raise GraphError(f"{n_edges} edges are declared, {found['lines']} are there")
        if found["lines"] and (found["least"] + shift < 1 or found["most"] + shift > n_vertices):
            raise GraphError(f"an edge ends outside 1 to {n_vertices}")
    edges = parsed.filter("src is not null and dst is not null").select(
        (F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"), F.lit(1.0).alias("weight")
    )
    return Graph(spark.range(1, n_vertices + 1).toDF("id"), edges)


def edge_lines(graph: Graph) -> DataFrame:
    """The graph as text lines in one column, ``part`` 0 holding the header and 1 the edges."""
    n_vertices = graph.vertices.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    head = graph.spark.createDataFrame([(0, f"{n_vertices}\n{graph.edges.count()}")], "part int, value string")
    body = graph.edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "dst").alias("value"))
    return head.unionByName(body)


def write_edge_list(graph: Graph, path: str) -> None:
    """Writes a folder ``part=0`` (header) and ``part=1`` (edges) that :func:`read_edge_list` takes as ``path/*``."""
    edge_lines(graph).write.partitionBy("part").text(path)


def read_edge_table(spark: SparkSession, path: str, src: str = "src", dst: str = "dst", weight: str | None = None) -> Graph:
    """A Parquet table of edges."""
    table = spark.read.parquet(path)
    columns = [F.col(src).alias("src"), F.col(dst).alias("dst")] + ([F.col(weight).alias("weight")] if weight else [])
    return Graph.from_edges(table.select(*columns))
