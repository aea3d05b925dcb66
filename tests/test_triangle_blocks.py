import random

import pytest

from loomgraph.model import Graph
from loomgraph.operators import triangles
from loomgraph.storage import Stage


def written(spark):
    """Bytes that this process has shuffled so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_wedges_are_not_shuffled(spark):
    n = 300  # complete: 44850 pairs, 4455100 wedges
    edges = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a != b], "src long, dst long")
    before, key = written(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)  # as with tables that are larger than this one
    try:
        assert triangles.triangle_total(Graph.from_edges(edges)).first()[0] == n * (n - 1) * (n - 2) // 6
    finally:
        spark.conf.unset(key)
    assert written(spark) - before < 10e6


def test_pairs_are_made_once(spark, tmp_path):
    from loomgraph.sources import derived

    lines = [(o, p) for o in range(400) for p in range(o % 7, o % 7 + 30)] + [(1, 5), (None, 1), (2, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    graph = derived.ordered_together(spark, str(tmp_path)).staged()
    # parts at most 29 apart were ordered together
    edges = {(a, b) for a in range(36) for b in range(36) if a != b and any(k <= min(a, b) and max(a, b) < k + 30 for k in range(7))}
    assert sorted(map(tuple, graph.edges.select("src", "dst").collect())) == sorted(edges)
    assert {r[0] for r in graph.vertices.collect()} == set(range(36))
    total = sum((a, c) in edges and (b, c) in edges for a, b in edges if a < b for c in range(b + 1, 36))
    assert triangles.triangle_total(graph).first()[0] == total
    counts = {r[0]: r[1] for r in triangles.triangle_counts(graph).collect()}
    assert counts.keys() == set(range(36)) and sum(counts.values()) == total


@pytest.mark.parametrize("hub", [0, 64])
def test_blocks_and_rounds_against_lists(spark, monkeypatch, hub):
    random.seed(7)
    edges = [(random.randint(1, 40), random.randint(1, 40)) for _ in range(500)] + [(-5, v) for v in range(1, 40)]
    edges += [(b, a) for a, b in edges if random.random() < 0.8] + [(1 << 60, 3), (3, 1 << 60), (4, 1 << 60), (1 << 60, 4), (3, 4), (4, 3)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    monkeypatch.setattr(triangles, "BLOCK", 10)  # more blocks than a round has
    monkeypatch.setattr(triangles, "HUB", hub)
    staged = []
    monkeypatch.setattr(triangles, "Stage", lambda df, name, *more: staged.append(name) or Stage(df, name, *more))
    got = {r[0]: r[1] for r in triangles.by_join(g).collect()}
    assert got == {r[0]: r[1] for r in triangles.by_lists(g).collect()}
    assert staged.count("triangles") > 1
    assert len(got) > 10
