import pytest

from lodestar.operators import ordering
from tests.fixtures import frame, hot_spot, scattered


def test_ranks_are_exact_with_hot_keys(spark):
    places = hot_spot(900, 1)
    ranked = ordering.ranked(frame(spark, places, 5), ["x", "uid"])
    rows = sorted(ranked.collect(), key=lambda row: row["rank"])
    assert [row["rank"] for row in rows] == list(range(900))
    assert [(row["x"], row["uid"]) for row in rows] == sorted((row["x"], row["uid"]) for row in rows)


@pytest.mark.parametrize("n", [0, 5, 200, 1000])
def test_first_rows(spark, n):
    points = frame(spark, scattered(700, 2), 9)
    assert [row["uid"] for row in ordering.first_rows(points, n, ["uid"]).collect()] == list(range(min(n, 700)))


def test_sort_puts_nulls_first(spark):
    rows = [(0, 1.0, 2.0), (1, None, 5.0), (2, 1.0, None), (3, 0.0, 9.0)]
    points = spark.createDataFrame(rows, "uid long, x double, y double")
    assert [row["uid"] for row in ordering.sort_xy(points).collect()] == [1, 3, 2, 0]


def test_unique_points_and_distances(spark):
    points = frame(spark, [(1, 1), (1, 1), (2, 2)])
    assert sorted(tuple(row) for row in ordering.unique_points(points).collect()) == [(0, 1.0, 1.0), (2, 2.0, 2.0)]


def test_sample_point_is_repeatable(spark):
    places = scattered(50, 3)
    first, again = (ordering.sample_point(frame(spark, places, n), 4).first() for n in (2, 7))
    assert first == again
