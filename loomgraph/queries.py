"""Queries over the driver's tables, one for each operator of the inventory, named by it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import UNREACHABLE, owner
from loomgraph.model import Graph
from loomgraph.operators import clusters, matrix, pagerank, paths, sorting, triangles
from loomgraph.operators.components import connected_components
from loomgraph.operators.spanning import spanning_forest
from loomgraph.operators.strong import strong_components
from loomgraph.plans import superstep as S
from loomgraph.sources import derived, edgelist, integers, results
from loomgraph.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def least_vertex(graph: Graph) -> int:
    return graph.vertices.agg(F.min("id")).first()[0]


def source_of(graph: Graph) -> int:
    """The vertex with the most targets, the smallest of them: a source that reaches something at every scale."""
    return graph.edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]


def folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def from_text(spark: SparkSession, sf_dir: str) -> Graph:
    """The next-line graph, written as edge-list text (ids from 1) and read again."""
    path = folder(spark, "edge-list")
    edgelist.write_edge_list(derived.next_line(spark, sf_dir).one_based(), path)
    return edgelist.read_edge_list(spark, f"{path}/*")


# ---- sources and partitioning ---------------------------------------------------------------------------------------


@query
def S1_edge_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_text(spark, sf_dir).edges.select("src", "dst")


@query
def S2_data_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text with comments and blank lines that carry data."""
    path = folder(spark, "commented")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" # "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.lit("  "))
    rows.select(F.coalesce(line, F.concat_ws(" ", "n_nationkey", "n_regionkey")).alias("value")).write.text(path)
    return edgelist.data_lines(spark, path).select(F.col("value").alias("line"))


@query
def S3_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.next_line(spark, sf_dir).adjacency()
    return rows.filter("degree > 0").select("id", "degree", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


@query
def S4_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.next_line(spark, sf_dir).one_based().edges.select("src", "dst")


@query
def S5_isolated_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees of all ids from 1 to the largest, of the priced graph: those without edges too."""
    g = derived.priced(spark, sf_dir)
    most = g.vertices.agg(F.max("id")).first()[0]
    return Graph(spark.range(1, most + 1).toDF("id"), g.edges).out_degrees()


@query
def S6_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a header declares, which the reader has checked against the lines."""
    g = from_text(spark, sf_dir)
    return g.vertices.agg(F.count("*").alias("n_vertices")).withColumn("n_edges", F.lit(g.edges.count()).cast("long"))


@query
def S7_hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.next_line(spark, sf_dir)
    return g.vertices.select("id", owner(F.col("id"), 3).alias("part"))


@query
def S8_neighbour_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.next_line(spark, sf_dir).placed(3).select("src", "dst", "loc")


@query
def S9_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each partition's subgraph, with the partitions that own their targets."""
    return derived.next_line(spark, sf_dir).placed(3)


@query
def S10_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.priced(spark, sf_dir).out_degrees()


@query
def S11_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.priced(spark, sf_dir).in_degrees()


@query
def S12_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.next_line(spark, sf_dir).summary(3)


@query
def S13_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.priced(spark, sf_dir).adjacency()
    return rows.select("id", "degree", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


@query
def S14_path_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.next_line(spark, sf_dir).staged()
    s = least_vertex(g)
    return results.path_lines(paths.shortest_paths(g, s).vertices, s)


@query
def S14_written_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances written as CSV with a header and read again."""
    g = derived.next_line(spark, sf_dir).staged()
    path = folder(spark, "result")
    results.write_result(paths.shortest_paths(g, least_vertex(g)).vertices.select("id", "value"), path, "csv")
    return spark.read.option("header", "true").schema("id long, value double").csv(path)


@query
def S15_integer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of part files, each with how often it is there."""
    path = folder(spark, "integers")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = rows.groupBy(F.pmod("o_orderkey", F.lit(50)).alias("p")).agg(F.concat_ws(" ", F.collect_list(F.col("o_custkey").cast("string"))).alias("t"))
    text.select(F.concat("t", F.lit(" ")).alias("value")).write.text(path)
    return integers.read_integers(spark, path).groupBy("v").agg(F.count("*").alias("n"))


# ---- one superstep, operator by operator ----------------------------------------------------------------------------


def ranked(graph: Graph, supersteps: int) -> DataFrame:
    """Vertex states after so many PageRank supersteps, in one plan."""
    program = pagerank.program()
    n = graph.vertices.count()
    state = S.initial(graph, program, n)
    for _ in range(supersteps):
        state = S.superstep(graph.edges, state, program, n)
    return state


@query
def D1_initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(derived.next_line(spark, sf_dir), 0).select("id", "out_degree", "value", "active")


@query
def D2_active_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.senders(ranked(derived.sparse(spark, sf_dir).staged(), 1)).select("id")


@query
def D3_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.sparse(spark, sf_dir).staged()
    return S.message_counts(S.messages(g.edges, S.senders(ranked(g, 1))), 3)


@query
def D4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.priced(spark, sf_dir)
    sent = S.messages(g.edges, S.senders(ranked(g, 0)))
    return sent.select("dst", "src", "value", "weight")


@query
def D5_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the first superstep, with the partitions that they go between."""
    g = derived.priced(spark, sf_dir)
    sent = S.messages(g.edges, S.senders(ranked(g, 0)))
    return sent.select(owner(F.col("src"), 4).alias("part"), owner(F.col("dst"), 4).alias("loc"), "dst", "src", "value", "weight")


@query
def D6_message_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.next_line(spark, sf_dir)
    return sorting.positions(g.edges.select("dst", "src"), None, "dst", "src").select("dst", "src", F.col("position").cast("long").alias("position"))


@query
def D7_predecessor_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of superstep 1, overwritten by what the vertices active after it send."""
    g = derived.sparse(spark, sf_dir).staged()
    first = S.messages(g.edges, ranked(g, 0)).select("dst", "src", "value", "weight")
    cache = S.upsert_predecessors(first, S.messages(g.edges, S.senders(ranked(g, 1))))
    return cache.select("dst", "src", F.round("value", 8).alias("value"), "weight")


@query
def D8_touched_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.sparse(spark, sf_dir).staged()
    state = ranked(g, 1)
    return S.touched(state, S.messages(g.edges, S.senders(state))).select("id")


@query
def D9_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.priced(spark, sf_dir)
    rows = S.materialised(g, ranked(g, 0))
    text = lambda c, f: F.array_join(F.transform(F.coalesce(c, F.array().cast(dict(rows.dtypes)[c])), lambda x: x[f].cast("string")), " ")
    return rows.select("id", "value", text("targets", "dst").alias("targets"), text("sources", "src").alias("sources"))


def pairs_of(graph: Graph) -> DataFrame:
    """Triangle counting's map: for each edge (least end, greatest end, source's target list)."""
    lists = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("svalue"))
    keyed = graph.edges.join(lists, "src")
    return keyed.select(F.least("src", "dst").alias("key"), F.greatest("src", "dst").alias("skey"), F.lit(1.0).alias("value"), "svalue")


@query
def D10_map_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs_of(derived.priced(spark, sf_dir))
    return rows.select("key", "skey", "value", F.size("svalue").cast("long").alias("n_svalue"))


@query
def D11_map_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made at the receiving partitions, from sources with the targets that each partition owns."""
    g = derived.priced(spark, sf_dir)
    return S.map_received(S.received(S.messages(g.edges, ranked(g, 0)), 3)).select("part", "key", "skey", "value")


@query
def D12_pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs_of(derived.priced(spark, sf_dir)).groupBy("key", "skey").agg(F.count("*").alias("n"))
    return sorting.positions(rows, None, "key", "skey").select("key", "skey", "n", F.col("position").cast("long").alias("position"))


@query
def D14_group_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs_of(derived.priced(spark, sf_dir))
    return rows.groupBy("key").agg(F.count("*").alias("n_pairs"), F.countDistinct("skey").alias("n_skeys"))


@query
def D15_group_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(derived.priced(spark, sf_dir)).groupBy("key", "skey").agg(F.count("*").alias("n_pairs"))


@query
def D16_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reduction in Python: the largest weight less the smallest of each target's edges."""
    g = derived.priced(spark, sf_dir)
    pairs = g.edges.select(F.col("dst").alias("key"), F.col("weight").alias("value"))

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [group.key.iloc[0]], "value": [group.value.max() - group.value.min()]})

    return S.reduce_pairs(pairs, spread, ["key"]).select("key", F.round("value", 6).alias("value"))


@query
def D17_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.priced(spark, sf_dir).staged()
    program, n = pagerank.program(), g.vertices.count()
    got = S.combined(S.messages(g.edges, S.initial(g, program, n)), program, n).withColumn("n", F.lit(n))
    return got.select("dst", F.round(program.apply, 8).alias("value"))


@query
def D18_reduce_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.priced(spark, sf_dir).edges.groupBy("dst").agg(F.min("weight").alias("value"))


@query
def D19_common_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair of mutual edges, the targets above both that they have in common."""
    return triangles.common_targets(derived.next_line(spark, sf_dir).staged()).select(F.col("a").alias("key"), F.col("b").alias("skey"), "n_common")


@query
def D20_update_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(derived.priced(spark, sf_dir).staged(), 1).select("id", F.round("value", 8).alias("value"))


@query
def D21_update_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice adding to each vertex the number of its predecessors."""
    g = derived.priced(spark, sf_dir).staged()
    program = S.VertexProgram(init=F.lit(0.0), message=F.lit(1.0), combine=F.sum, update="accu")
    n = g.vertices.count()
    state = S.initial(g, program, n)
    for _ in range(2):
        state = S.superstep(g.edges, state, program, n)
    return state.select("id", "value")


@query
def D22_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(derived.sparse(spark, sf_dir).staged(), 2).select("id", "active")


@query
def D23_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(derived.priced(spark, sf_dir).staged(), 2).agg(F.round(F.max("deviation"), 8).alias("residual"))


@query
def D24_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of settled vertices after three supersteps, cut to hundredths of a percent; all are settled at 10000."""
    state = ranked(derived.sparse(spark, sf_dir).staged(), 3)
    share = F.floor(F.count_if(~F.col("active")) * 10000 / F.count("*"))
    return state.agg(F.count_if("active").alias("n_active"), share.cast("long").alias("converged"))


@query
def D25_iteration_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank stopped by its cap of three supersteps."""
    out = pagerank.pagerank(derived.priced(spark, sf_dir).staged(), max_supersteps=3)
    return out.vertices.select("id", F.round("value", 8).alias("value"))


@query
def D27_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each superstep of shortest paths logs, but the seconds."""
    g = derived.next_line(spark, sf_dir).staged()
    logged = paths.shortest_paths(g, least_vertex(g)).metrics_frame()
    return logged.select("step", F.round("converged_pct", 6).alias("converged_pct"), "residual", "least_residual", "messages", "bytes")


@query
def D28_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and bytes of a whole run of shortest paths: each reached vertex sends once along each edge."""
    g = derived.next_line(spark, sf_dir).staged()
    t = S.totals(paths.shortest_paths(g, least_vertex(g)))
    return spark.createDataFrame([(t["messages"], t["bytes"])], "messages long, bytes long")


@query
def D29_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading bad edge lists raises: the kind of error, for each kind of fault."""
    texts = {"no header": "", "malformed line": "3\n2\n1 2\nx\n", "edge count": "3\n5\n1 2\n", "vertex range": "2\n1\n1 7\n", "none": "3\n1\n1 3\n"}
    rows = []
    for fault, text in {**texts, "no file": None}.items():
        path = folder(spark, "faulty")
        if text is not None:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        try:
            edgelist.read_edge_list(spark, path)
            rows.append((fault, "read"))
        except (edgelist.GraphError, FileNotFoundError) as e:
            rows.append((fault, type(e).__name__))
    return spark.createDataFrame(rows, "fault string, outcome string")


# ---- algorithms -----------------------------------------------------------------------------------------------------


@query
def A1_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pagerank.pagerank(derived.next_line(spark, sf_dir).staged())
    return out.vertices.select("id", F.round("value", 8).alias("rank"))


@query
def A1_pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten supersteps on the sparse graph; vertices without predecessors keep 1."""
    out = pagerank.pagerank(derived.sparse(spark, sf_dir).staged(), max_supersteps=10, tolerance=0.0)
    return out.vertices.select("id", F.round("value", 8).alias("rank"))


@query
def A2_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.next_line(spark, sf_dir).staged()
    return paths.shortest_paths(g, least_vertex(g)).vertices.select("id", F.col("value").alias("distance"))


@query
def A2_shortest_paths_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.sparse(spark, sf_dir).staged()
    out = paths.shortest_paths(g, source_of(g), weighted=True).vertices
    return out.select("id", F.round("value", 4).alias("distance"))


@query
def A2_shortest_paths_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreachable vertices as the largest single-precision number."""
    g = derived.sparse(spark, sf_dir).staged()
    out = paths.shortest_paths(g, source_of(g)).vertices
    return out.select("id", F.coalesce("value", F.lit(UNREACHABLE)).alias("distance"))


@query
def A3_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles.triangle_counts(derived.ordered_together(spark, sf_dir).staged())


@query
def A3_triangle_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangles.triangle_total(derived.ordered_together(spark, sf_dir).staged())


@query
def A3_triangles_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a directed graph: only mutual edges make pairs."""
    return triangles.triangle_counts(derived.next_line(spark, sf_dir).staged())


@query
def A4_matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square of the sparse graph's weights in hundredths, which are whole numbers."""
    cents = F.round(100 * F.col("weight")).cast("long").alias("value")
    m = derived.sparse(spark, sf_dir).edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), cents)
    return matrix.multiply(m, m)


@query
def A5_breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.sparse(spark, sf_dir).staged()
    return paths.breadth_first(g, source_of(g)).vertices.filter("value is not null").select("id", F.col("value").cast("long").alias("level"))


@query
def A6_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(derived.sparse(spark, sf_dir).edges)


@query
def A7_spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the minimum spanning forest."""
    return spanning_forest(derived.sparse(spark, sf_dir).edges)


@query
def A8_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_components(derived.sparse(spark, sf_dir).staged())


@query
def A9_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the embeddings after three iterations from the five vectors with the smallest ids."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    points = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    first = points.orderBy("id").limit(5).collect()
    import numpy as np

    centres = clusters.kmeans(points, np.array([r["features"] for r in first]), 3)
    return clusters.assigned(points, centres)


# ---- sorting --------------------------------------------------------------------------------------------------------


@query
def O1_sample_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's customer with its place in the sorted sequence (equal values share their places' sum)."""
    v = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("v"))
    placed = sorting.positions(v, None, "v")
    return placed.groupBy("v").agg(F.min("position").cast("long").alias("first"), F.max("position").cast("long").alias("last"))


@query
def O2_sorted_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the ranges that don't depend on the sampled bounds: all rows are there, and ranges don't overlap."""
    v = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("v"))
    r = sorting.ranges(v, 3, "v")
    other = r.select(F.col("part").alias("q"), F.col("low").alias("l"))
    overlaps = r.join(other, (F.col("part") < F.col("q")) & (F.col("high") >= F.col("l")))  # three rows each
    facts = r.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return facts.withColumn("overlaps", F.lit(overlaps.count()).cast("long"))


@query
def O3_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's quantities in ascending order."""
    rows = derived.lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("q"))
    return rows.select("l_orderkey", F.array_join(F.transform(sorting.sorted_list("q"), lambda x: x.cast("string")), " ").alias("quantities"))


@query
def O4_sorted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of another type: the names of each brand's parts in ascending order."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.collect_list("p_name").alias("names"))
    return rows.select("p_brand", F.array_join(sorting.sorted_list("names"), "|").alias("names"))


@query
def O5_sorted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance: the place of each."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return sorting.positions(rows, None, "c_acctbal", "c_custkey").select("c_custkey", F.col("position").cast("long").alias("position"))


@query
def O6_sorted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with weights by target, then source: the place of each."""
    rows = derived.priced(spark, sf_dir).edges.select("dst", "src", "weight")
    return sorting.positions(rows, None, "dst", "src").select("dst", "src", "weight", F.col("position").cast("long").alias("position"))


@query
def O7_sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs with a second key: by customer, then order."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("skey"))
    return sorting.positions(rows, None, "key", "skey").select("key", "skey", F.col("position").cast("long").alias("position"))


# ---- programs -------------------------------------------------------------------------------------------------------


@query
def U1_vertex_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of the user's: the largest id that reaches each vertex in at most three hops."""
    program = S.VertexProgram(
        init=F.col("id"), message=F.col("value"), combine=F.max, apply=F.greatest("value", "combined"), frontier=True, max_supersteps=3, tolerance=0.0
    )
    return S.run(derived.priced(spark, sf_dir).staged(), program).vertices.select("id", F.col("value").cast("long").alias("largest"))


@query
def U2_map_in_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map in Python: each edge as a pair of its ends in order."""

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        low, high = batch[["src", "dst"]].min(axis=1), batch[["src", "dst"]].max(axis=1)
        return pd.DataFrame({"key": low, "skey": high, "value": batch.weight, "svalue": [[s, d] for s, d in zip(batch.src, batch.dst, strict=True)]})

    rows = S.map_pairs(derived.priced(spark, sf_dir).edges, work)
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query
def U3_reduce_in_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program whose reduction is the user's own aggregate in Python: the median weight of the edges into a vertex."""

    @F.pandas_udf("double")
    def median(x: pd.Series) -> float:
        return float(x.median())

    program = S.VertexProgram(init=F.lit(0.0), message=F.col("weight"), combine=median, max_supersteps=1)
    return S.run(derived.priced(spark, sf_dir), program).vertices.select("id", F.round("value", 4).alias("median"))
