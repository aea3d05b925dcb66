import pytest

from loomgraph.model import GraphError
from loomgraph.sources.edgelist import read_edge_list, write_edge_list
from loomgraph.sources.integers import read_integers


def write(tmp_path, text):
    path = tmp_path / "a.graph"
    path.write_text(text)
    return str(path)


def edges(graph):
    return sorted((r.src, r.dst) for r in graph.edges.collect())


@pytest.mark.parametrize("between", [" ", ",", "\t", " -> ", " , "])
def test_separators(spark, tmp_path, between):
    g = read_edge_list(spark, write(tmp_path, f"3\n2\n1{between}2\n2{between}3\n"))
    assert edges(g) == [(1, 2), (2, 3)]
    assert g.vertices.count() == 3


def test_comments_blanks_and_further_columns(spark, tmp_path):
    g = read_edge_list(spark, write(tmp_path, "# a\n\n3\n # b\n2\n\n1 2 0.5\n   # c\n2 3 7\n"))
    assert edges(g) == [(1, 2), (2, 3)]


def test_ids_from_zero(spark, tmp_path):
    assert edges(read_edge_list(spark, write(tmp_path, "3\n2\n0 1\n1 2\n"))) == [(1, 2), (2, 3)]


def test_gaps_first_and_last_vertices(spark, tmp_path):
    g = read_edge_list(spark, write(tmp_path, "6\n2\n2 4\n4 2\n"))
    assert sorted((r.id, r.out_degree) for r in g.out_degrees().collect()) == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0), (6, 0)]


def test_ungrouped_parallel_and_loops(spark, tmp_path):
    g = read_edge_list(spark, write(tmp_path, "3\n5\n3 1\n1 2\n3 3\n1 2\n2 1\n"))
    assert edges(g) == [(1, 2), (1, 2), (2, 1), (3, 1), (3, 3)]


@pytest.mark.parametrize("text", ["3\n3\n1 2\n2 3\n", "2\n2\n1 2\n2 3\n", "3\n2\n1 2\nx y\n", "3\n", "a\nb\n"])
def test_errors(spark, tmp_path, text):
    with pytest.raises(GraphError):
        read_edge_list(spark, write(tmp_path, text))


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_edge_list(spark, str(tmp_path / "none.graph"))


def test_round_trip(spark, tmp_path):
    g = read_edge_list(spark, write(tmp_path, "4\n3\n1 2\n2 3\n3 4\n"))
    write_edge_list(g, str(tmp_path / "out"))
    assert edges(read_edge_list(spark, str(tmp_path / "out/*"))) == [(1, 2), (2, 3), (3, 4)]


def test_integers(spark, tmp_path):
    for i, t in enumerate(["3 1 2 ", "5\n4  5", ""]):
        (tmp_path / f"number.part.{i}").write_text(t)
    assert sorted(r.v for r in read_integers(spark, str(tmp_path / "number.part.*")).collect()) == [1, 2, 3, 4, 5, 5]
