import random

from loomgraph.operators import components


def test_few_links_take_one_task(spark, monkeypatch):
    random.seed(3)
    links = [(random.randint(-50, 400), random.randint(-50, 400)) for _ in range(300)] + [(500, 500), (501, 501), (500, 500)]
    links += [(k, k + 1) for k in range(1000, 1200)] + [(1 << 61, 1200)]
    edges = spark.createDataFrame(links, "src long, dst long")
    staged = []
    stage = components.Stage
    monkeypatch.setattr(components, "Stage", lambda df, name: staged.append(name) or stage(df, name))
    few = sorted(map(tuple, components.connected_components(edges).collect()))
    assert len(staged) == 2  # no rounds of stars, which took eight tables and more
    monkeypatch.setattr(components, "FEW", 0)
    assert few == sorted(map(tuple, components.connected_components(edges).collect()))
    none = edges.limit(0)
    monkeypatch.setattr(components, "FEW", 1)
    assert components.connected_components(none).count() == 0
