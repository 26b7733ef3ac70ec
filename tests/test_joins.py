"""Joins of many query points, against brute force, on even, skewed and degenerate data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import joins
from tests.fixtures import frame, hot_spot, scattered

QUERIES = "query_id long, x double, y double, r double"


def brute(places, queries, exclude="coords"):
    """(query, dist, uid) of all points within each query's radius."""
    out = []
    for q, qx, qy, r in queries:
        for uid, (x, y) in enumerate(places):
            d = math.sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy))
            left_out = (x, y) == (qx, qy) if exclude == "coords" else uid == q if exclude == "uid" else False
            if d <= r and not left_out:
                out.append((q, d, uid))
    return sorted(out)


def nearest(places, queries, k, exclude="coords"):
    out = []
    for q in queries:
        own = brute(places, [(q[0], q[1], q[2], math.inf)], exclude)[:k]
        out += [(i, d, uid, n) for n, (i, d, uid) in enumerate(own, 1)]
    return sorted(out)


def asked(spark, queries):
    return spark.createDataFrame(queries, QUERIES)


def some_queries(places, n, seed):
    rng = random.Random(seed)
    at = [rng.choice(places) for _ in range(n)]
    queries = [(i, float(x), float(y), rng.choice([0.0, 0.5, 3.0, 20.0, 1e4])) for i, (x, y) in enumerate(at)]
    return queries + [(n, -1e6, 3.0, 999_990.0), (n + 1, 55.5, 1e9, 2.0), (n + 2, 1e7, -1e7, 1.5e7)]


SETS = {
    "scattered": scattered(700, 1),
    "hot spot": hot_spot(600, 4),
    "one place": [(3.0, 4.0)] * 200,
    "line": [(float(i), 7.0) for i in range(300)],
    "far apart": [(0.0, 0.0), (1e9, 1e-9), (1e-9, 1e9), (5.0, 5.0), (5.0, 5.0)],
}


@pytest.mark.parametrize("name, part_rows, exclude", [("scattered", 20, "coords"), ("hot spot", 20, "none"), ("hot spot", joins.PART_ROWS, "uid"), ("one place", 20, "uid"), ("line", joins.PART_ROWS, "coords"), ("far apart", 2, "coords")])
def test_range_join(spark, name, part_rows, exclude):
    places = [(float(x), float(y)) for x, y in SETS[name]]
    queries = some_queries(places, 40, 2)
    found = joins.range_join(frame(spark, places, 3), asked(spark, queries), None, exclude, part_rows=part_rows)
    assert sorted((r["query_id"], r["dist"], r["uid"]) for r in found.collect()) == brute(places, queries, exclude)


@pytest.mark.parametrize("name, k, part_rows", [("scattered", 7, 20), ("scattered", 5000, joins.PART_ROWS), ("hot spot", 60, 20), ("one place", 1, 20), ("line", 7, joins.PART_ROWS), ("far apart", 2, 2)])
def test_knn_join(spark, name, k, part_rows):
    places = [(float(x), float(y)) for x, y in SETS[name]]
    queries = some_queries(places, 12, 5)
    found = joins.knn_join(frame(spark, places, 3), asked(spark, queries).drop("r"), k, part_rows=part_rows).collect()
    assert sorted((r["query_id"], r["dist"], r["uid"], r["rank"]) for r in found) == nearest(places, queries, k)


def test_odd_rows(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 0.0), (4, float("inf"), 0.0), (5, 1.0, 2.5)], "uid long, x double, y double")
    queries = asked(spark, [(1, 1.0, 2.0, 1.0), (2, None, 1.0, 9.0), (3, 1.0, 2.0, -1.0), (4, 1.0, 2.0, None), (5, float("nan"), 1.0, 1.0), (6, 1.0, 2.0, float("inf")), (1, 1.0, 2.0, 1.0)])
    got = joins.range_join(points, queries).collect()
    assert [(r["query_id"], r["uid"], r["dist"]) for r in got] == [(1, 5, 0.5)] * 2
    assert [tuple(r) for r in joins.knn_join(points, queries.limit(1), 5, exclude="none").orderBy("rank").collect()] == [(1, 1, 1.0, 2.0, 0.0, 1), (1, 5, 1.0, 2.5, 0.5, 2)]
    for empty_points, empty_queries in ((points.limit(0), queries), (points, queries.limit(0))):
        assert joins.range_join(empty_points, empty_queries, 5.0).count() == joins.knn_join(empty_points, empty_queries, 3).count() == 0
    assert joins.knn_join(points, queries, 0).count() == 0
    with pytest.raises(ValueError):
        joins.range_join(points, queries, exclude="what")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_plan_and_spread(spark):
    """A third of the points at one place, and a third of the queries: no product of tables, and the place is split."""
    places = [(50.0, 50.0)] * 3000 + [(float(x), float(y)) for x, y in scattered(6000, 3)]
    queries = [(i, 50.0, 50.0, 0.0) for i in range(170)] + [(i, *places[-i], 1.0) for i in range(170, 500)]
    points, some = frame(spark, places, 4), asked(spark, queries)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.range_join(points, some, exclude="none", part_rows=100)
        plan = plan_of(joined)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
        assert joined.count() == len(brute(places, queries, "none"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    held = spark.createDataFrame([(i, 1.0, 1.0) for i in range(3000)], "uid long, x double, y double")
    crowded = spark.createDataFrame([(0, 0, 0, 30, 2)], "level int, cx long, cy long, point_parts long, query_parts long")
    cell = held.select("*", *[F.lit(0).cast(t).alias(c) for c, t in (("level", "int"), ("cx", "long"), ("cy", "long"))])
    units = joins._parted(cell, crowded, "point_parts", "query_parts", F.col("uid")).groupBy("unit").count().collect()
    assert len(units) == 60 and max(u["count"] for u in units) < 200


def test_pyramid(spark):
    places = scattered(500, 9)
    points = frame(spark, places, 2)
    grid = joins.Grid.around(points)
    levels = joins.pyramid(points, grid, 5).collect()
    assert {r["level"] for r in levels} == set(range(6))
    assert all(sum(r["n"] for r in levels if r["level"] == level) == 500 for level in range(6))
    for r in levels:
        if r["level"]:
            up = [u for u in levels if (u["level"], u["cx"], u["cy"]) == (r["level"] - 1, r["cx"] >> 1, r["cy"] >> 1)]
            assert up[0]["n"] >= r["n"]


def test_far_queries_meet_few_points(spark, monkeypatch):
    """Queries far outside of the data, all nearest to one corner: a few leaves each, and a leaf is lent to parts of them."""
    places = [(float(x), float(y)) for x, y in scattered(4000, 6)]
    queries = [(i, 5e3 + 40.0 * i, 3e3 + 7.0 * (i % 13), 0.0) for i in range(150)] + [(i, -9e3, 1.0 * i, 0.0) for i in range(150, 200)]
    met, join = [], joins._met

    def counted(*given):
        met.append(join(*given))
        return met[-1]

    monkeypatch.setattr(joins, "_met", counted)
    found = joins.knn_join(frame(spark, places, 3), asked(spark, queries).drop("r"), 10, part_rows=20).collect()
    assert sorted((r["query_id"], r["dist"], r["uid"], r["rank"]) for r in found) == nearest(places, queries, 10)
    assert met[-1].count() < len(queries) * len(places) / 8
    parts = met[-1].groupBy("node", "part").agg(F.countDistinct("q").alias("n")).agg(F.max("n"), F.count_if(F.col("part") > 0)).first()
    assert parts[0] < 60 and parts[1] > 0


@pytest.mark.parametrize("exclude", ["coords", "uid", "none"])
def test_knn_join_of_copies(spark, exclude):
    """More copies of a place than neighbours are asked for, and identifiers that many points share."""
    places = [(1.0, 1.0)] * 90 + [(float(x), float(y)) for x, y in scattered(300, 8)]
    rows = [(uid % 7 if uid % 3 else uid, x, y) for uid, (x, y) in enumerate(places)] + [(None, 1.0, 1.0), (None, 2.0, 2.0)]
    queries = [(0, 1.0, 1.0), (1, 1.5, 1.5), (2, 900.0, -3.0), (3, 1.0, 1.0), (None, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "uid long, x double, y double")
    found = joins.knn_join(points, spark.createDataFrame(queries, "query_id long, x double, y double"), 12, exclude).collect()
    want = []
    for q, qx, qy in queries:
        left_out = {"coords": lambda u, x, y: (x, y) == (qx, qy), "uid": lambda u, x, y: u is None or q is None or u == q, "none": lambda u, x, y: False}[exclude]  # noqa: B023
        near = sorted((math.sqrt((x - qx) ** 2 + (y - qy) ** 2), -1 if u is None else u) for u, x, y in rows if not left_out(u, x, y))
        want += [(q, d, u, n) for n, (d, u) in enumerate(near[:12], 1)]
    key = lambda r: (-1 if r[0] is None else r[0], r[3])
    assert sorted(((r["query_id"], r["dist"], -1 if r["uid"] is None else r["uid"], r["rank"]) for r in found), key=key) == sorted(want, key=key)
