import math

import pytest

from lodestar.functions.geometry import Location
from lodestar.operators import hull
from tests.fixtures import brute_diameter, brute_hull, frame, hot_spot, ring, scattered

SETS = {
    "one": [(3, 4)],
    "equal": [(3, 4)] * 5,
    "two": [(0, 0), (3, 4)],
    "three": [(0, 0), (3, 4), (6, 0)],
    "level": [(i, 2) for i in range(6)],
    "upright": [(2, i) for i in range(6)],
    "slanted": [(i, 2 * i) for i in range(-3, 4)],
    "square": [(x, y) for x in range(5) for y in range(5)],
    "diamond": [(x, y) for x in range(-4, 5) for y in range(-4, 5) if abs(x) + abs(y) <= 4],
    "scattered": scattered(400, 1),
    "ties": scattered(400, 2, grid=12),
    "ring": ring(97),
    "even ring": ring(96),
    "hot": hot_spot(300, 3),
    "flat": [(i * 1000.0, math.sin(i)) for i in range(50)],
}


SPLIT = ["three", "square", "scattered", "ties", "ring", "hot"]


@pytest.mark.parametrize(
    "name, limit, small", [(name, 100_000, small) for name in SETS for small in (0, hull.SMALL)] + [(name, 2, 0) for name in SPLIT]
)
def test_hull_and_diameter_match_brute_force(spark, name, limit, small):
    places = SETS[name]
    edges = hull.convex_hull(frame(spark, places), pocket_limit=limit, small=small)
    rows = [tuple(row) for row in edges.collect()]
    assert {(row[0], row[1]) for row in rows} == brute_hull(places)
    assert {(row[2], row[3]) for row in rows} == brute_hull(places)
    assert len(rows) == len(brute_hull(places))
    assert hull.hull_diameter(edges, small).first()["diameter"] == brute_diameter(places)


def test_no_points(spark):
    empty = frame(spark, [])
    assert hull.convex_hull(empty).count() == 0
    assert hull.diameter(empty).first()["diameter"] is None


def test_unusable_coordinates_are_left_out(spark):
    rows = [(0, 0.0, 0.0), (1, 3.0, 4.0), (2, math.nan, 1.0), (3, math.inf, 1.0), (4, None, 1.0), (5, 1.0, -math.inf)]
    points = spark.createDataFrame(rows, "uid bigint, x double, y double")
    assert hull.diameter(points).first()["diameter"] == 5.0
    assert tuple(hull.envelope(points).first()) == (0.0, 3.0, 0.0, 4.0)


@pytest.mark.parametrize(
    "places, area, centre",
    [
        (SETS["square"], 16.0, (2.0, 2.0)),
        (SETS["three"], 12.0, (3.0, 4 / 3)),
        (SETS["level"], 0.0, (2.5, 2.0)),
        (SETS["one"], 0.0, (3.0, 4.0)),
    ],
)
def test_area_and_centroid(spark, places, area, centre):
    row = hull.hull_measures(hull.convex_hull(frame(spark, places)), Location(-1.0, 2.0)).first()
    assert row["area"] == pytest.approx(area)
    assert (row["cx"], row["cy"]) == pytest.approx(centre)


def test_split_pockets_cover_a_long_ring(spark):
    places = ring(1000)
    edges = hull.convex_hull(frame(spark, places), pocket_limit=50, small=0)
    assert edges.count() == len(brute_hull(places))
    assert hull.hull_diameter(edges, 0).first()["diameter"] == brute_diameter(places)
