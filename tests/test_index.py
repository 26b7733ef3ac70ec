import math

import pytest
from pyspark.sql import functions as F

from lodestar import build_index, load_index
from lodestar.functions.geometry import Location, plain_quadrant, quadrant_of
from lodestar.operators import pivots, search
from lodestar.operators.knn import knn, nearest_rows
from lodestar.session import scratch_path
from tests.fixtures import brute_pivots, brute_range, frame, gap, hot_spot, scattered

SETS = {
    "scattered": scattered(600, 11),
    "ties": scattered(600, 12, grid=15),
    "hot": hot_spot(600, 13),
    "line": [(i % 40, 0) for i in range(200)],
    "equal": [(5, 5)] * 30,
    "one": [(5, 5)],
}


@pytest.fixture(scope="module")
def built(spark):
    return {name: build_index(frame(spark, places), scratch_path(spark, "test")) for name, places in SETS.items()}


@pytest.mark.parametrize("name", SETS)
def test_pivots_are_those_of_the_sequential_pass(built, name):
    assert [p.uid for p in built[name].pivots] == brute_pivots(SETS[name])


@pytest.mark.parametrize("name", SETS)
def test_pivots_are_sparse_and_maximal(built, name):
    index, places = built[name], SETS[name]
    spacing = 0.37 * index.extent.diameter
    where = [p.place for p in index.pivots]
    assert all(gap(a, b) >= spacing for i, a in enumerate(where) for b in where[:i])
    assert spacing == 0 or all(any(gap(p, w) < spacing for w in where) for p in places)


@pytest.mark.parametrize("name", SETS)
def test_index_keeps_all_points_and_counts_them(built, name):
    index = built[name]
    assert index.points.count() == len(SETS[name])
    assert sum(q["n"] for q in index.quadrants.values()) == len(SETS[name])


QUERIES = [Location(5.0, 5.0), Location(0.25, -3.5), Location(500.0, -900.0)]


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("q", QUERIES)
@pytest.mark.parametrize("r", [0.0, 20.0, 1500.0])
def test_range_query_matches_brute_force(built, name, q, r):
    index = built[name]
    rows = index.range_query(q, r).collect()
    assert index.range_query(q, r, pivot_bounds=True).collect() == rows
    assert [(row["dist"], row["uid"]) for row in rows] == brute_range(SETS[name], q, r)


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("r", [20.0, 90.0, 1500.0])
def test_certain_hits_are_hits_and_hits_survive_pruning(built, name, r):
    index, q = built[name], Location(0.25, -3.5)
    certain = {row["uid"] for row in index.certain_hits(q, r).collect()}
    hits = {i for _, i in brute_range(SETS[name], q, r)}
    kept = {row["uid"] for row in search.pivot_prune(index.points, index.pivots, q, r).collect()}
    assert certain <= hits <= kept


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("q", QUERIES[::2])
@pytest.mark.parametrize("k", [0, 10, 250])
def test_knn_matches_brute_force(spark, built, name, q, k):
    want = brute_range(SETS[name], q, math.inf)[:k]
    for found in (built[name].knn(q, k), knn(frame(spark, SETS[name]), q, k)):
        assert [(row["dist"], row["uid"]) for row in found.collect()] == want


def test_knn_beyond_the_data_gives_all_of_it(spark, built):
    q, want = QUERIES[1], brute_range(SETS["hot"], QUERIES[1], math.inf)
    for found in (built["hot"].knn(q, 5000), knn(frame(spark, SETS["hot"]), q, 5000)):
        assert [(row["dist"], row["uid"]) for row in found.collect()] == want


def test_knn_with_very_many_equal_distances_is_ranked_exactly(spark, monkeypatch):
    monkeypatch.setattr("lodestar.operators.ordering.MERGE_ROWS", 50)
    places = [(3, 4)] * 400 + scattered(200, 21)
    want = brute_range(places, (0.0, 0.0), math.inf)[:300]
    found = knn(frame(spark, places), Location(0.0, 0.0), 300)
    assert [(row["dist"], row["uid"]) for row in found.collect()] == want


def test_nearest_rows_counts_distance_zero(spark):
    rows = spark.createDataFrame([(i, 0.0, 0.0, 0.0) for i in range(40)], "uid long, x double, y double, dist double")
    assert [row["uid"] for row in nearest_rows(rows, 20).collect()] == list(range(20))


def test_exclusion_choices(built, spark):
    points = frame(spark, [(1, 1), (1, 1), (2, 1)])
    q = Location(1.0, 1.0)

    def uids(**options):
        return [row["uid"] for row in search.range_query(points, [], q, 5.0, **options).collect()]

    assert uids() == [2]
    assert uids(exclude="uid", uid=0) == [1, 2]
    assert uids(exclude="none") == [0, 1, 2]
    with pytest.raises(ValueError):
        uids(exclude="rest")


def test_stored_index_opens_unchanged(spark):
    path = scratch_path(spark, "stored")
    built = build_index(frame(spark, SETS["hot"]), path)
    opened = load_index(spark, path)
    assert (opened.pivots, opened.extent, opened.quadrants) == (built.pivots, built.extent, built.quadrants)
    assert opened.points.exceptAll(built.points).count() == 0


def test_index_by_another_order(spark):
    places = scattered(100, 5)
    points = frame(spark, places).withColumn("age", -F.col("uid"))
    index = build_index(points, scratch_path(spark, "aged"), order_by="age")
    assert [99 - p.uid for p in index.pivots] == brute_pivots(places[::-1])


def test_empty_input_is_refused(spark):
    with pytest.raises(ValueError):
        build_index(frame(spark, []), scratch_path(spark, "none"))


def test_too_small_a_diameter_is_noticed(spark):
    with pytest.raises(RuntimeError):
        pivots.sss_pivots(frame(spark, scattered(300, 6)), 1.0)


def test_hot_place_is_spread_over_files(spark):
    places = [(9, 9)] * 3000 + scattered(1500, 8)
    index = build_index(frame(spark, places), scratch_path(spark, "spread"), partitions=6)
    sizes = [row["count"] for row in index.points.groupBy(F.input_file_name().alias("f")).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * len(places) / 6


def test_quadrant_ties_and_density(spark, built):
    centre = Location(0.0, 0.0)
    places = [(0, 0), (0, -1), (1, 0), (-1, 0), (-1, -1), (1, -1), (0, 1)]
    names = ["UPPER LEFT", "LOWER RIGHT", "UPPER RIGHT", "UPPER LEFT", "LOWER LEFT", "LOWER RIGHT", "UPPER LEFT"]
    rows = frame(spark, places).select("uid", quadrant_of("x", "y", centre).alias("quadrant")).orderBy("uid")
    assert [row["quadrant"] for row in rows.collect()] == names
    assert [plain_quadrant(p, centre) for p in places] == names
    flat = built["line"]
    assert all(q["density"] is None for q in flat.quadrants.values())
    assert flat.initial_range(Location(0.0, 0.0), 3) == math.inf


def test_random_pivots(spark):
    points = frame(spark, scattered(300, 9))
    drawn = pivots.random_pivots(points, seed=1, pool=50)
    rows = drawn.orderBy("ord").collect()
    assert [row["ord"] for row in rows] == list(range(100))
    assert all(row["uid"] < 50 for row in rows) and len({row["uid"] for row in rows}) < 100
    assert rows == pivots.random_pivots(points, seed=1, pool=50).orderBy("ord").collect()
    assert rows != pivots.random_pivots(points, seed=2, pool=50).orderBy("ord").collect()
    assert pivots.random_pivots(points.limit(0), seed=1).count() == 0


def test_closest_pivot_tie_goes_to_the_first(spark):
    two = [pivots.Pivot("pivot_0", 0, 0, 0.0, 0.0), pivots.Pivot("pivot_1", 1, 1, 2.0, 0.0)]
    row = pivots.closest_pivot(frame(spark, [(1, 0)]), two).first()
    assert (row["closest_pivot"], row["dp_closest"]) == ("pivot_0", 1.0)


def test_missing_stored_distance_stops(spark):
    pairs = spark.createDataFrame([(1, "pivot_0"), (2, "pivot_0")], "uid long, pivot_id string")
    stored = spark.createDataFrame([("pivot_0", 1, 2.5)], "pivot_id string, uid long, dist double")
    assert pivots.lookup_pivot_distance(pairs.limit(1), stored).first()["dist"] == 2.5
    with pytest.raises(Exception, match="no stored distance"):
        pivots.lookup_pivot_distance(pairs, stored).collect()


def test_the_pyramid_gives_one_round_on_skewed_data(spark, monkeypatch):
    """Half of the points in a corner, at a density that no quadrant shows."""
    places = [(i % 30 / 100, i // 30 / 100) for i in range(900)] + scattered(900, 77)
    index = build_index(frame(spark, places), scratch_path(spark, "skewed"))
    assert sum(n for _, _, n in index.pyramid.cells) == len(places)
    searches = []
    real = search.within
    monkeypatch.setattr(search, "within", lambda *args: searches.append(args) or real(*args))
    for q in (Location(0.1, 0.1), Location(-20.0, 40.0), Location(900.0, 3.0)):
        for k in (1, 40, 1500):
            searches.clear()
            rows = index.knn(q, k).collect()
            assert [(row["dist"], row["uid"]) for row in rows] == brute_range(places, q, math.inf)[:k]
            assert len(searches) == 1, (q, k)
    quadrant_only = index.initial_range(Location(0.1, 0.1), 40)
    assert index.pyramid.radius(Location(0.1, 0.1), 40) < quadrant_only
    assert index.pyramid.radius(Location(0.0, 0.0), 1801) is None
