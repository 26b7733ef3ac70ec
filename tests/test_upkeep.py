"""Changes to a stored index: equal to a fresh build, sparing of files, and safe when they fail."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar import build_index, clean_index, load_index, update_index
from lodestar.functions.geometry import Location
from lodestar.plans import upkeep
from lodestar.session import scratch_path
from lodestar.sources.versions import Conflict, read_version
from tests.fixtures import POINT_SCHEMA, brute_range, frame, scattered

QUERIES = [Location(5.0, 5.0), Location(0.25, -3.5), Location(500.0, -900.0)]


def stored(index):
    return {r["uid"]: (r["x"], r["y"]) for r in index.points.collect()}


def answers_like(index, places):
    """Everything that the index says equals what the places say."""
    assert stored(index) == places
    assert index.extent.n == len(places) == sum(q["n"] for q in index.quadrants.values())
    assert (index.extent.min_x, index.extent.max_y) == (min(x for x, _ in places.values()), max(y for _, y in places.values()))
    for q in QUERIES:
        for r in (0.0, 20.0, 1500.0):
            want = sorted((d, uid) for uid, p in places.items() if (d := math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)) <= r and p != tuple(q))
            for bounds in (False, True):
                assert [(row["dist"], row["uid"]) for row in index.range_query(q, r, pivot_bounds=bounds).collect()] == want
        want = sorted((math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2), uid) for uid, p in places.items() if p != tuple(q))[:30]
        assert [(row["dist"], row["uid"]) for row in index.knn(q, 30).collect()] == want


def points(spark, places):
    return spark.createDataFrame([(uid, float(x), float(y)) for uid, (x, y) in places.items()], POINT_SCHEMA)


def test_changes_equal_a_fresh_build(spark):
    path, rng = scratch_path(spark, "living"), random.Random(1)
    places = {i: p for i, p in enumerate(scattered(600, 31))}
    build_index(points(spark, places), path, rows_per_file=80)
    for turn in range(2):
        moved = {i: (rng.gauss(0, 12), rng.uniform(-60, 60)) for i in rng.sample(sorted(places), 40)}
        new = {10_000 * (turn + 1) + i: (rng.gauss(0, 12), rng.uniform(-60, 60)) for i in range(25)}
        gone = rng.sample(sorted(places), 30)
        gone_frame = spark.createDataFrame([(i,) for i in [*gone, 777_777]], "uid long")
        index = update_index(spark, path, points(spark, moved | new), gone_frame, rows_per_file=80)
        places = {i: p for i, p in places.items() if i not in gone} | moved | new
        answers_like(index, places)
        answers_like(load_index(spark, path), places)
    kept = clean_index(spark, path)
    assert kept and stored(load_index(spark, path)) == places


def test_only_files_that_change_are_written(spark):
    path = scratch_path(spark, "living")
    places = {i: (float(i % 100), float(i // 100)) for i in range(10_000)}
    build_index(points(spark, places), path, rows_per_file=400)
    near = {20_000 + i: (3.0 + i / 1000, 4.0) for i in range(100)}  # one per cent, all at one place
    index = update_index(spark, path, points(spark, near), rows_per_file=400)
    _, content = read_version(spark, path)
    assert content["files"] >= 20 and content["rewritten"] <= 3
    assert stored(index) == places | near and index.covered
    untouched = update_index(spark, path, points(spark, {}), spark.createDataFrame([(999_999,)], "uid long"))
    assert read_version(spark, path)[1]["rewritten"] == 0 and stored(untouched) == places | near


def test_a_failure_leaves_the_old_index(spark, monkeypatch):
    path = scratch_path(spark, "living")
    places = {i: p for i, p in enumerate(scattered(200, 5))}
    build_index(points(spark, places), path)

    def dies(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as broken:
        broken.setattr(upkeep, "publish_version", dies)
        with pytest.raises(OSError):
            update_index(spark, path, points(spark, {1: (0.0, 0.0)}))
        broken.setattr("lodestar.plans.index.publish_version", dies)
        with pytest.raises(OSError):
            build_index(points(spark, {1: (0.0, 0.0)}), path)
    assert stored(load_index(spark, path)) == places
    gone = clean_index(spark, path)
    assert len(gone) == 2 and stored(load_index(spark, path)) == places


def test_of_two_writers_one_is_refused(spark, monkeypatch):
    path = scratch_path(spark, "living")
    places = {i: p for i, p in enumerate(scattered(100, 6))}
    build_index(points(spark, places), path)
    real = upkeep.publish_version
    first = {}

    def second_comes_first(*args):
        if not first:
            first["done"] = True
            update_index(spark, path, points(spark, {500: (1.0, 1.0)}))
        return real(*args)

    monkeypatch.setattr(upkeep, "publish_version", second_comes_first)
    with pytest.raises(Conflict):
        update_index(spark, path, points(spark, {501: (2.0, 2.0)}))
    assert stored(load_index(spark, path)) == places | {500: (1.0, 1.0)}


def test_odd_changes(spark):
    path = scratch_path(spark, "living")
    places = {i: p for i, p in enumerate(scattered(100, 7))}
    index = build_index(points(spark, places), path)
    assert index.covered
    rows = [(1, 9.0, 9.0, 1), (1, 5.0, 5.0, 2), (1, 7.0, 1.0, 2), (2, math.nan, 1.0, 1), (3, None, 1.0, 1), (4, math.inf, 0.0, 1), (None, 1.0, 1.0, 1), (5, 8.0, 8.0, 1)]
    changes = spark.createDataFrame(rows, "uid long, x double, y double, ts int")
    index = update_index(spark, path, changes, spark.createDataFrame([(5,), (6,), (None,)], "uid long"))
    want = {i: p for i, p in places.items() if i not in (2, 3, 4, 6)} | {1: (7.0, 1.0), 5: (8.0, 8.0)}
    answers_like(index, want)
    assert update_index(spark, path).extent == index.extent
    far = update_index(spark, path, points(spark, {900: (5000.0, 5000.0)}))
    assert not far.covered and not load_index(spark, path).covered
    answers_like(far, want | {900: (5000.0, 5000.0)})
    with pytest.raises(ValueError, match="no points"):
        update_index(spark, path, None, far.points.select("uid"))
    answers_like(build_index(far.points, path), want | {900: (5000.0, 5000.0)})


def test_text_identifiers(spark):
    path = scratch_path(spark, "living")
    named = frame(spark, scattered(50, 8)).withColumn("uid", F.concat(F.lit("point_"), "uid"))
    build_index(named, path)
    index = update_index(spark, path, named.filter("uid = 'point_7'").withColumn("x", F.lit(1.5)))
    assert index.points.count() == 50 and index.points.filter("x = 1.5").select("uid").collect() == [("point_7",)]
    assert brute_range([(0.0, 0.0)], (1.0, 0.0), 2.0) == [(1.0, 0)]
