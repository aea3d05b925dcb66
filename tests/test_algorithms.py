import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.model import Graph
from loomgraph.operators import clusters, matrix, pagerank, paths, sorting, triangles
from loomgraph.operators.components import connected_components
from loomgraph.operators.spanning import spanning_forest
from loomgraph.operators.strong import strong_components
from loomgraph.plans import superstep as S
from loomgraph.sources.results import path_lines

# The undirected ten-vertex graph of the fixtures.
TEN = [(1, 2), (1, 3), (1, 4), (1, 5), (1, 10), (2, 3), (2, 6), (2, 7), (3, 8), (3, 9), (4, 5)]


def graph(spark, edges, n, both=False):
    rows = edges + [(b, a) for a, b in edges] if both else edges
    e = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src long, dst long, weight double")
    return Graph(spark.range(1, n + 1).toDF("id"), e)


def column(df, name="value"):
    return {r.id: r[name] for r in df.collect()}


def test_pagerank_ten(spark):
    out = pagerank.pagerank(graph(spark, TEN, 10, True))
    got = column(out.vertices)
    expected = {1: 0.16672889961843024, 2: 0.15560562281648638, 3: 0.15560562281648638, 4: 0.08891384808306008, 5: 0.08891384808306008}
    expected |= dict.fromkeys((6, 7, 8, 9), 0.0694569088512548) | {10: 0.06667918138058268}
    assert out.converged and len(out.metrics) == 15
    assert all(abs(got[i] - v) < 1e-6 for i, v in expected.items())


def test_pagerank_keeps_values_without_predecessors(spark):
    got = column(pagerank.pagerank(graph(spark, [(1, 2), (2, 3), (3, 2)], 4)).vertices)
    assert got[1] == got[4] == 1.0
    assert abs(got[2] - 0.9167175) < 1e-5 and abs(got[3] - 0.5833435) < 1e-5


def test_shortest_paths(spark):
    out = paths.shortest_paths(graph(spark, TEN, 10, True), 1)
    assert column(out.vertices) == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 2, 10: 1}
    assert out.converged and len(out.metrics) == 3
    assert S.totals(out)["messages"] == 22


def test_unreachable_is_null_and_shown_as_sentinel(spark):
    out = paths.shortest_paths(graph(spark, [(1, 2), (2, 3), (3, 2)], 4), 1).vertices
    assert column(out) == {1: 0, 2: 1, 3: 2, 4: None}
    lines = column(path_lines(out, 1), "line")
    assert lines[3] == "path_len(1, 3):2.000000" and "340282346638528859811704183484516925440.000000" in lines[4]


def test_weighted_paths_triangle_inequality(spark):
    random.seed(4)
    rows = [(random.randint(1, 30), random.randint(1, 30), random.randint(1, 9) / 1) for _ in range(120)]
    g = Graph(spark.range(1, 31).toDF("id"), spark.createDataFrame(rows, "src long, dst long, weight double"))
    d = column(paths.shortest_paths(g, 1, weighted=True).vertices)
    best = {1: 0.0}
    for _ in range(30):
        for a, b, w in rows:
            if a in best:
                best[b] = min(best.get(b, math.inf), best[a] + w)
    assert d == {i: best.get(i) for i in range(1, 31)}
    assert all(d[b] <= d[a] + w for a, b, w in rows if d[a] is not None)


def test_paths_longer_than_any_cap(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_MESSAGES", 2)  # wide at first: states of all vertices, then only those touched
    far = [(i, i + 1) for i in range(1, 130)] + [(1, 200), (1, 201), (200, 2)]
    g = graph(spark, far, 201)
    out = paths.breadth_first(g, 1)
    expected = {i: i - 1 if i <= 130 else None for i in range(1, 202)} | {200: 1, 201: 1}
    assert column(out.vertices) == expected and out.converged and len(out.metrics) == 130
    assert column(paths.shortest_paths(g, 1, weighted=True).vertices) == expected
    assert not paths.breadth_first(g, 1, max_supersteps=5).converged


def test_negative_cycle_is_an_error(spark):
    rows = spark.createDataFrame([(1, 2, 1.0), (2, 1, -2.0)], "src long, dst long, weight double")
    with pytest.raises(RuntimeError):
        paths.shortest_paths(Graph.from_edges(rows), 1, weighted=True)


def test_triangles_ten(spark):
    got = column(triangles.triangle_counts(graph(spark, TEN, 10, True)), "triangles")
    assert got == {1: 2} | dict.fromkeys(range(2, 11), 0)
    assert triangles.triangle_total(graph(spark, TEN, 10, True)).first()[0] == 2


@pytest.mark.parametrize(
    ("edges", "expected"),
    [
        ([(a, b) for a in range(1, 5) for b in range(1, 5) if a != b], {1: 3, 2: 1}),  # complete
        ([(1, 2), (2, 3), (3, 2), (1, 3), (3, 1)], {}),  # 1-2 is one way
        ([(1, 2), (1, 2), (2, 1), (2, 3), (3, 2), (1, 3), (3, 1)], {}),  # three edges between 1 and 2
        ([(1, 2), (2, 1), (1, 3), (1, 3), (2, 3)], {1: 2}),  # a repeated third vertex multiplies
        ([(1, 1), (1, 2), (2, 1)], {}),  # loop
    ],
)
def test_triangle_rules(spark, edges, expected):
    g = graph(spark, edges, 4)
    assert column(triangles.by_join(g), "triangles") == expected
    assert column(triangles.by_lists(g), "triangles") == expected


def test_triangles_do_not_depend_on_names(spark):
    random.seed(2)
    edges = list({(a, b) for a, b in ((random.randint(1, 12), random.randint(1, 12)) for _ in range(40)) if a < b})
    names = random.sample(range(1, 13), 12)
    other = [(names[a - 1], names[b - 1]) for a, b in edges]
    assert triangles.triangle_total(graph(spark, edges, 12, True)).first() == triangles.triangle_total(graph(spark, other, 12, True)).first()


def components(n, edges):
    label = list(range(n + 1))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_connected_components(spark):
    random.seed(3)
    edges = [(random.randint(1, 40), random.randint(1, 40)) for _ in range(25)] + [(i, i + 1) for i in range(50, 80)]
    got = column(connected_components(graph(spark, edges, 80).edges), "component")
    label = components(90, edges)
    assert got == {i: label[i] for e in edges for i in e}


def test_strong_components(spark):
    random.seed(5)
    edges = [(random.randint(1, 20), random.randint(1, 20)) for _ in range(34)]
    reach = {i: {i} for i in range(1, 21)}
    for _ in range(20):
        for a, b in edges:
            for r in reach.values():
                if a in r:
                    r.add(b)
    expected = {i: min(j for j in reach[i] if i in reach[j]) for i in range(1, 21)}
    assert column(strong_components(graph(spark, edges, 20)), "component") == expected


def test_spanning_forest(spark):
    random.seed(6)
    rows = [(random.randint(1, 25), random.randint(1, 25), float(random.randint(1, 6))) for _ in range(50)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = spanning_forest(df).collect()
    parent = list(range(26))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, n = 0.0, 0
    for w, a, b in sorted((w, a, b) for a, b, w in rows):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total, n = total + w, n + 1
    assert len(got) == n and sum(r.weight for r in got) == total
    assert spanning_forest(df.limit(0)).count() == 0


def test_matrix_product(spark):
    a = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (1, 1, 5)], "i long, j long, value long")
    assert sorted(matrix.multiply(a, a).collect()) == [(0, 0, 4), (0, 1, 21), (1, 1, 25)]


def test_kmeans(spark):
    import numpy as np

    rows = [(i, [float(i % 2) * 10 + i * 0.01, 1.0]) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, features array<double>")
    centres = clusters.kmeans(points, np.array([[0.0, 0.0], [5.0, 0.0]]), 5)
    got = column(clusters.assigned(points, centres), "cluster")
    assert got == {i: i % 2 for i in range(40)}


def test_sorting(spark):
    random.seed(7)
    values = [random.randint(1, 50) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    parts = sorting.range_sorted(df, 3, "v").rdd.glom().collect()
    assert [r.v for p in parts for r in p] == sorted(values)
    assert [r.v for r in sorting.positions(df, 3, "v").orderBy("position").collect()] == sorted(values)
    assert [r.position for r in sorting.positions(df, 3, "v").orderBy("position").collect()] == list(range(1, 301))


def test_accumulate_and_python_hooks(spark):
    g = graph(spark, [(1, 2), (3, 2), (2, 1)], 3)
    program = S.VertexProgram(init=F.lit(0.0), message=F.lit(1.0), combine=F.sum, update="accu", max_supersteps=2)
    assert column(S.run(g, program).vertices) == {1: 2.0, 2: 4.0, 3: 0.0}
    import pandas as pd

    pairs = S.map_pairs(g.edges, lambda b: pd.DataFrame({"key": b.dst, "skey": -1, "value": b.weight, "svalue": [[] for _ in range(len(b))]}))
    got = S.reduce_pairs(pairs, lambda p: pd.DataFrame({"key": [p.key.iloc[0]], "value": [p.value.sum()]}), ["key"])
    assert sorted(got.collect()) == [(1, 1.0), (2, 2.0)]


def test_empty_graph(spark):
    g = Graph(spark.range(1, 4).toDF("id"), spark.createDataFrame([], "src long, dst long, weight double"))
    assert column(pagerank.pagerank(g).vertices) == {1: 1.0, 2: 1.0, 3: 1.0}
    assert column(paths.shortest_paths(g, 1).vertices) == {1: 0.0, 2: None, 3: None}
    assert column(triangles.triangle_counts(g), "triangles") == {1: 0, 2: 0, 3: 0}
    assert connected_components(g.edges).count() == 0
    assert column(strong_components(g), "component") == {1: 1, 2: 2, 3: 3}


def test_predecessor_cache(spark):
    cache = spark.createDataFrame([(1, 2, 0.5, 1.0), (1, 3, 0.7, 1.0)], "dst long, src long, value double, weight double")
    sent = spark.createDataFrame([(1, 3, 0.9, 1.0, 1), (4, 3, 0.9, 1.0, 1)], "dst long, src long, value double, weight double, out_degree long")
    assert sorted(S.upsert_predecessors(cache, sent).collect()) == [(1, 2, 0.5, 1.0), (1, 3, 0.9, 1.0), (4, 3, 0.9, 1.0)]
