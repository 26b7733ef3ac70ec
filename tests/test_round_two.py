"""What the loaders, ranks, rebuilds and matches must hold to at any size."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from lodestar import build_index, load_index
from lodestar.functions.geometry import Location
from lodestar.operators import hull, lookup, ordering, pivots
from lodestar.operators.knn import knn
from lodestar.session import scratch_path
from lodestar.sources import tables, text
from tests.fixtures import brute_diameter, brute_pivots, brute_range, frame, hot_spot, scattered


def test_lines_keep_their_numbers_when_splits_change_before_the_action(spark, tmp_path):
    (tmp_path / "nodes.txt").write_text("".join(f"{i} {i}.5 1\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        lines = text.read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7777")
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["line"] for r in rows) == list(range(5000))
    assert all(int(r["value"].split()[0]) == r["line"] for r in rows)


def test_bad_lines_go_to_quarantine_on_the_load_path(spark, tmp_path):
    (tmp_path / "nodes.txt").write_text("0 1 2\n1 x 2\n2 2\n3 4 5\n")
    loaded = text.load_points(spark, str(tmp_path / "nodes.txt"), quarantine=str(tmp_path / "bad"))
    assert sorted(tuple(r) for r in loaded.collect()) == [("point_0", 2.0, 1.0), ("point_3", 5.0, 4.0)]
    assert sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [1, 2]


def test_running_offsets(spark):
    rows = [(i * 37 % 101, i) for i in range(101)]
    sizes = spark.createDataFrame(rows, "k long, n long")
    got = {r["k"]: r["before"] for r in ordering.running_offsets(sizes, ["k"]).collect()}
    total = 0
    for k, n in sorted(rows):
        assert got[k] == total
        total += n


@pytest.mark.parametrize("column", ["number", "name"])
@pytest.mark.parametrize("n", [1, 40, 399, 1000])
def test_first_rows_by_bounds(spark, monkeypatch, column, n):
    monkeypatch.setattr(ordering, "MERGE_ROWS", 0)
    values = [i * 7919 % 400 for i in range(400)]
    rows = [(float(v), f"point_{v}", i) for i, v in enumerate(values)] + [(3.0, "point_3", 1000 + i) for i in range(50)]
    table = spark.createDataFrame(rows, "number double, name string, uid long").repartition(5)
    place = {"number": 0, "name": 1}[column]
    want = sorted((r[place], r[2]) for r in rows)[:n]
    found = ordering.first_rows(table, n, [column, "uid"])
    assert [(r[column], r["uid"]) for r in found.collect()] == want
    bound = table.filter(ordering._not_after(table, n, column)).count()
    assert min(n, len(rows)) <= bound <= 2 * n + 60


def test_ties_of_the_last_distance_stay_in_their_tasks(spark, monkeypatch):
    """A third of the rows at one distance: no task hands on more than k of them."""
    monkeypatch.setattr(ordering, "MERGE_ROWS", 50)
    k, places = 100, [(3, 4)] * 2000 + scattered(4000, 5)
    kept = []
    real = ordering.numbered
    monkeypatch.setattr(ordering, "numbered", lambda df, name: kept.append(df.count()) or real(df, name))
    points = frame(spark, places, 4)
    found = knn(points, Location(0.0, 0.0), k).collect()
    assert [(r["dist"], r["uid"]) for r in found] == brute_range(places, (0.0, 0.0), 1e9)[:k]
    assert kept and max(kept) <= k * points.rdd.getNumPartitions()


def needle(n):
    return [(i, (i / n) ** 2 * 1e-3) for i in range(n)] + [(n / 2, -1e-6)]


def test_diameter_of_a_needle_spreads(spark):
    places = needle(400)
    edges = hull.convex_hull(frame(spark, places), small=0)
    assert hull.hull_diameter(edges, 0).first()["diameter"] == brute_diameter(places)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, _ = hull._by_direction(edges)
        sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) <= 0.6 * sum(sizes)


def text_points(spark, places):
    return frame(spark, places).withColumn("uid", F.concat(F.lit("point_"), F.format_string("%05d", "uid")))


@pytest.mark.parametrize("places", [scattered(500, 3), hot_spot(300, 8), [(1, 1)] * 5])
def test_pivots_of_text_uids(spark, places, monkeypatch):
    found = pivots.sss_pivots(text_points(spark, places), brute_diameter(places))
    assert [int(p.uid.split("_")[1]) for p in found] == brute_pivots(places)
    shared = frame(spark, places).withColumn("uid", F.concat(F.lit("a_very_long_prefix_"), F.lpad(F.col("uid").cast("string"), 30, "0")))
    assert [int(p.uid.split("_")[-1]) for p in pivots.sss_pivots(shared, brute_diameter(places))] == brute_pivots(places)


def test_the_scan_for_text_uids_is_a_hash_aggregate(spark):
    points = text_points(spark, scattered(100, 4))
    scan = points.groupBy("x").agg(F.min(pivots._text_code(points, "uid")))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_small_alpha_reopens(spark, tmp_path):
    places = scattered(3000, 12)
    built = build_index(frame(spark, places), str(tmp_path), alpha=0.03)
    assert len(built.pivots) > 100
    assert load_index(spark, str(tmp_path)).pivots == built.pivots


def test_parts_of_two_builds_are_refused(spark, tmp_path):
    build_index(frame(spark, scattered(50, 1)), f"{tmp_path}/a")
    build_index(frame(spark, scattered(50, 2)), f"{tmp_path}/b")
    (a,), (b,) = (glob.glob(f"{tmp_path}/{name}/build-*/points") for name in "ab")
    os.rename(a, f"{tmp_path}/old")
    os.rename(b, a)
    with pytest.raises(ValueError, match="different builds"):
        load_index(spark, f"{tmp_path}/a")


def test_files_follow_from_the_rows(spark, tmp_path):
    built = build_index(frame(spark, scattered(1000, 6)), str(tmp_path), rows_per_file=100)
    sizes = [r["count"] for r in built.points.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 250


def test_upsert_reads_the_base_once(spark, tmp_path):
    frame(spark, [(1, 1), (2, 2)]).withColumn("ts", F.lit(1)).write.parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base")
    merged = tables.upserted(base, base.withColumn("x", F.col("x") + 5).withColumn("ts", F.lit(2)))
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Relation [uid") == 1
    assert sorted(r["x"] for r in merged.collect()) == [6.0, 7.0]


def test_stored_distance(spark, tmp_path):
    built = build_index(frame(spark, scattered(200, 9)), str(tmp_path))
    near = built.points.select("dp_closest", pivots.stored_distance(built.pivots, "closest_pivot").alias("dist"))
    assert near.filter("dist <> dp_closest").count() == 0
    with pytest.raises(Exception, match="no stored distance"):
        built.points.select(pivots.stored_distance(built.pivots, "quadrant")).collect()


def test_accented_words_stay_whole(spark):
    texts = spark.createDataFrame([(1, "Le théâtre, l'été 2024"), (2, "th tre")], "id long, text string")
    words = {(r["id"], r["term"]) for r in lookup.postings(texts, "id", "text").collect()}
    assert words == {(1, "le"), (1, "théâtre"), (1, "l"), (1, "été"), (1, "2024"), (2, "th"), (2, "tre")}


def test_scratch_is_given_back(spark):
    folder = os.path.dirname(scratch_path(spark, "mark"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.cancelDeleteOnExit(target) and files.deleteOnExit(target)
