"""The graph: a pair of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import owner
from loomgraph.storage import staged


def ends(edges: DataFrame) -> DataFrame:
    """(id) of the ends of edges."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


VERTEX_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False)])
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("src", T.LongType(), False),
        T.StructField("dst", T.LongType(), False),
        T.StructField("weight", T.DoubleType(), False),
    ]
)


class GraphError(ValueError):
    """The input does not describe a graph."""


@dataclass(frozen=True)
class Graph:
    """``vertices`` (id) and directed ``edges`` (src, dst, weight); parallel edges and self-loops are kept."""

    vertices: DataFrame
    edges: DataFrame
    #: The vertices are the ends of the edges.
    implicit: bool = False
    #: (a, b), a < b, once each, if the edges are these pairs, both ways, and no others.
    pairs: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """From (src, dst[, weight]); vertices are the ends of edges unless given."""
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))
        if vertices is None:
            return cls(ends(e), e, True)
        return cls(vertices.select(F.col("id").cast("long").alias("id")), e)

    @classmethod
    def from_pairs(cls, pairs: DataFrame) -> Graph:
        """From distinct (a, b), a < b: an edge each way."""
        one = F.lit(1.0).alias("weight")
        ways = [pairs.select(F.col(x).alias("src"), F.col(y).alias("dst"), one) for x, y in ("ab", "ba")]
        e = ways[0].unionByName(ways[1])
        return cls(ends(e), e, True, pairs)

    def staged(self) -> Graph:
        """The same graph, written once to the shared folder: what is derived from it doesn't derive it again."""
        if self.pairs is not None:
            return Graph.from_pairs(staged(self.pairs, "pairs", True))
        e = staged(self.edges, "edges")
        return Graph(staged(ends(e) if self.implicit else self.vertices, "vertices"), e, self.implicit)

    def one_based(self) -> Graph:
        """Adds 1 to every id if the smallest source is 0."""
        least = self.edges.agg(F.min("src")).first()[0]
        if least != 0:
            return self
        return Graph(
            self.vertices.select((F.col("id") + 1).alias("id")),
            self.edges.select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"), "weight"),
        )

    def symmetric(self) -> Graph:
        """Each edge in both directions, once, with the least weight."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        both = self.edges.unionByName(back).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
        return Graph(self.vertices, both)

    def deduplicated(self) -> Graph:
        return Graph(self.vertices, self.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))

    def out_degrees(self) -> DataFrame:
        """(id, out_degree) of every vertex."""
        n = self.edges.groupBy("src").agg(F.count("*").alias("out_degree"))
        joined = self.vertices.join(n, F.col("id") == F.col("src"), "left")
        return joined.select("id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))

    def in_degrees(self) -> DataFrame:
        n = self.edges.groupBy("dst").agg(F.count("*").alias("in_degree"))
        joined = self.vertices.join(n, F.col("id") == F.col("dst"), "left")
        return joined.select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))

    def adjacency(self) -> DataFrame:
        """(id, degree, neighbours) with neighbours in ascending order; what a dump shows."""
        lists = self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
        joined = self.vertices.join(lists, F.col("id") == F.col("src"), "left")
        none = F.array().cast("array<bigint>")
        return joined.select("id", F.coalesce("neighbours", none).alias("neighbours")).select(
            "id", F.size("neighbours").cast("long").alias("degree"), "neighbours"
        )

    def placed(self, parts: int) -> DataFrame:
        """Edges with the partitions that own their source and target."""
        return self.edges.select("src", "dst", owner(F.col("src"), parts).alias("part"), owner(F.col("dst"), parts).alias("loc"))

    def summary(self, parts: int = 1) -> DataFrame:
        """(part, n_vertices, n_edges): edges live with their source."""
        v = self.vertices.groupBy(owner(F.col("id"), parts).alias("part")).agg(F.count("*").alias("n_vertices"))
        e = self.edges.groupBy(owner(F.col("src"), parts).alias("part")).agg(F.count("*").alias("n_edges"))
        return v.join(e, "part", "left").select("part", "n_vertices", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"))

    def partitioned(self, parts: int | None = None) -> Graph:
        """Edges dealt and sorted by source and held (memory, then disk): supersteps shuffle vertices and messages only."""
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        held = self.edges.repartition(n, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
        return Graph(ends(held) if self.implicit else self.vertices, held, self.implicit)

    def release(self) -> None:
        self.edges.unpersist()
        self.vertices.unpersist()
