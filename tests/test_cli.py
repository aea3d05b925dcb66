import pytest

from loomgraph import cli


@pytest.fixture
def graph(tmp_path):
    path = tmp_path / "a.graph"
    path.write_text("4\n6\n1 2\n1 3\n2 1\n2 3\n3 1\n3 2\n")
    return str(path)


def test_paths(spark, graph, capsys):
    assert cli.main(["sssp", graph]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:3] == ["path_len(1, 1):0.000000", "path_len(1, 2):1.000000", "path_len(1, 3):1.000000"]


def test_triangles_is_the_default(spark, graph, capsys):
    args = cli.parser().parse_args([])
    assert (args.algorithm, args.source) == ("trianglecount", 1)
    assert cli.main(["trianglecount", graph]) == 0
    assert capsys.readouterr().out.splitlines() == ["None\t1", "1\t1"]


@pytest.mark.parametrize("algorithm", ["pagerank", "bfs", "components", "scc", "mst"])
def test_others_run(spark, graph, tmp_path, algorithm):
    out = str(tmp_path / "out")
    assert cli.main([algorithm, graph, "--out", out, "--max-iter", "5"]) == 0
    assert spark.read.parquet(out).count() >= 2


def test_errors(spark, tmp_path, capsys):
    assert cli.main(["sssp", str(tmp_path / "none.graph")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
