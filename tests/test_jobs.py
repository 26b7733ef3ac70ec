import pytest
from pyspark.sql import functions as F

from lodestar import load_index
from lodestar.__main__ import arguments, run
from lodestar.functions.geometry import Location
from lodestar.streaming.queries import stream_decode
from tests.fixtures import brute_pivots, brute_range, scattered

PLACES = scattered(300, 77)


@pytest.fixture(scope="module")
def index_path(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    source = folder / "nodes.txt"
    source.write_text("".join(f"{i} {y!r} {x!r}\n" for i, (x, y) in enumerate(PLACES)))
    run(spark, arguments().parse_args(["import", str(source), str(folder / "index")]))
    return str(folder / "index")


def uids(spark, path):
    rows = spark.read.parquet(path).collect()
    return sorted((row["dist"], int(row["uid"].split("_")[1])) for row in rows)


def test_range_and_knn_from_the_command_line(spark, index_path, tmp_path):
    q = (1.0, -2.0)
    run(spark, arguments().parse_args(["range", index_path, "1", "--out", str(tmp_path / "r"), "--", "-2", "9.5"]))
    assert uids(spark, str(tmp_path / "r")) == brute_range(PLACES, q, 9.5)
    run(spark, arguments().parse_args(["knn", index_path, "1", "--out", str(tmp_path / "k"), "--", "-2", "40"]))
    assert uids(spark, str(tmp_path / "k")) == brute_range(PLACES, q, 1e9)[:40]


def test_results_are_shown_without_out(spark, index_path, capsys):
    run(spark, arguments().parse_args(["knn", index_path, "1.0", "2.0", "3"]))
    assert "point_" in capsys.readouterr().out


def test_published_points_carry_their_distances(spark, index_path, tmp_path):
    run(spark, arguments().parse_args(["publish", index_path, f"path={tmp_path}/topic"]))
    index = load_index(spark, index_path)
    sent = stream_decode(spark.read.text(f"{tmp_path}/topic"))
    assert sent.count() == len(PLACES)
    last = index.pivots[-1]
    stored = index.points.select("uid", F.col(f"dp_{last.ord}").alias("stored"))
    wrong = sent.join(stored, "uid").filter(F.col("distances")[last.pivot_id] != F.col("stored"))
    assert wrong.count() == 0


def test_text_identifiers_order_as_text(spark, index_path):
    index = load_index(spark, index_path)
    assert index.pivots[0].uid == "point_0"
    order = sorted(range(len(PLACES)), key=lambda i: f"point_{i}")
    chosen = brute_pivots([PLACES[i] for i in order])
    assert [p.uid for p in index.pivots] == [f"point_{order[i]}" for i in chosen]
    assert index.initial_range(Location(0.0, 0.0), 5) > 0


def test_pivots_in_the_order_of_the_lines(spark, tmp_path):
    source = tmp_path / "nodes.txt"
    source.write_text("".join(f"{i} {y!r} {x!r}\n" for i, (x, y) in enumerate(PLACES)))
    run(spark, arguments().parse_args(["import", "--file-order", str(source), str(tmp_path / "index")]))
    chosen = load_index(spark, str(tmp_path / "index")).pivots
    assert [p.uid for p in chosen] == [f"point_{i}" for i in brute_pivots(PLACES)]
