"""Hulls and diameters of many groups, against brute force for each."""

import random

import pytest

from lodestar.operators import group_hull
from tests.fixtures import brute_diameter, brute_hull, hot_spot, ring, scattered

GROUPS = {
    "one": [(3, 4)], "equal": [(3, 4)] * 5, "two": [(0, 0), (3, 4)], "line": [(i, 2 * i) for i in range(9)],
    "square": [(x, y) for x in range(5) for y in range(5)], "hot": hot_spot(900, 3), "ring": ring(97), None: scattered(60, 5),
}


def frame(spark, groups):
    rows = [(key, i % 2, float(x), float(y)) for key, places in groups.items() for i, (x, y) in enumerate(places)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([*rows, ("none", 0, None, 1.0), ("one", 0, float("nan"), 1.0)], "k string, odd int, x double, y double")


@pytest.mark.parametrize("part", [group_hull.PART, 40])
def test_groups_match_brute_force(spark, part):
    edges = group_hull.group_hulls(frame(spark, GROUPS), ["k"], part)
    found = {}
    for r in edges.collect():
        found.setdefault(r["k"], []).append(r)
    assert found.keys() == GROUPS.keys()
    for key, rows in found.items():
        want = brute_hull(GROUPS[key])
        assert {(r["ax"], r["ay"]) for r in rows} == {(r["bx"], r["by"]) for r in rows} == want and len(rows) == len(want), key
    wide = {r["k"]: r["diameter"] for r in group_hull.group_diameters(edges, ["k"], part).collect()}
    assert wide == {key: brute_diameter(places) for key, places in GROUPS.items()}
    measures = {r["k"]: (r["vertices"], r["area"]) for r in group_hull.group_measures(edges, ["k"]).collect()}
    assert measures["square"] == (4, 16.0) and measures["one"] == (1, 0.0)


def test_two_keys_and_no_rows(spark):
    points = frame(spark, {"hot": GROUPS["hot"]})
    edges = group_hull.group_hulls(points, ["k", "odd"], 60).collect()
    for odd in (0, 1):
        want = brute_hull([p for i, p in enumerate(GROUPS["hot"]) if i % 2 == odd])
        assert {(r["ax"], r["ay"]) for r in edges if r["odd"] == odd} == want
    assert group_hull.group_hulls(points.limit(0), ["k"]).count() == 0
