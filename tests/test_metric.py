"""The index over vectors, against brute force."""

import math

import numpy as np
import pytest

from lodestar.plans import metric
from lodestar.session import scratch_path

SCHEMA = "uid long, vector array<float>"


def clustered(n, dims, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims)) * 4
    return np.float32(centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.5)


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def apart(a, b):
    return math.sqrt(((a.astype(float) - b.astype(float)) ** 2).sum())


def slow_pivots(vectors, spacing, most):
    chosen = []
    for i, v in enumerate(vectors):
        if len(chosen) < most and all(apart(v, vectors[j]) >= spacing for j in chosen):
            chosen.append(i)
    return chosen


@pytest.fixture(scope="module")
def built(spark):
    vectors = clustered(900, 16, 12, 1)
    vectors[600:] = vectors[5]  # a third at one place
    index = metric.build_vector_index(frame(spark, vectors), scratch_path(spark, "vectors"), 8.0, rows_per_file=200)
    return vectors, index


@pytest.mark.parametrize("spacing, most, survivors", [(8.0, 64, 256), (3.0, 64, 10), (3.0, 7, 256)])
def test_pivots_are_those_of_the_sequential_pass(spark, monkeypatch, spacing, most, survivors):
    monkeypatch.setattr(metric, "SURVIVORS", survivors)
    vectors = clustered(300, 5, 9, 2)
    found = metric.select_pivots(frame(spark, vectors).selectExpr("uid", "CAST(vector AS ARRAY<DOUBLE>) AS vector"), spacing, most)
    assert [uid for uid, _ in found] == slow_pivots(vectors, spacing, most) and len(found) > 5


def test_searches_are_exact(spark, built):
    vectors, index = built
    queries = [vectors[3], vectors[5], vectors[700] + 0.3, np.full(16, 100.0), np.zeros(16)]
    for q in queries:
        dist = [apart(v, q) for v in vectors]
        for r in (0.0, 2.0, 6.0, 1000.0):
            want = sorted((i, round(d, 6)) for i, d in enumerate(dist) if d <= r)
            assert sorted((row["uid"], round(row["dist"], 6)) for row in index.range_query(q.tolist(), r).collect()) == want
        for k in (0, 1, 40, 350, 5000):
            want = sorted((round(d, 6), i) for i, d in enumerate(dist))[:k]
            got = [(round(row["dist"], 6), row["uid"]) for row in index.knn(q.tolist(), k).collect()]
            assert got == want
            assert got == [(round(row["dist"], 6), row["uid"]) for row in metric.scan_knn(frame(spark, vectors), q.tolist(), k).collect()]


def test_little_is_read(spark, built):
    vectors, index = built
    read = index.rows_read(vectors[3].tolist(), 2.0)
    assert read["stored"] == 900 and read["measured"] <= read["read"] < 300
    assert "near" in index.candidates(vectors[3].tolist(), 2.0)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 2.0]), (8, [4.0, 6.0])]
    path = scratch_path(spark, "vectors")
    metric.build_vector_index(spark.createDataFrame(rows, SCHEMA), path, 1.0)
    found = metric.open_vector_index(spark, path).knn([1.0, 2.0], 10).collect()
    assert [(r["uid"], r["dist"]) for r in found] == [(1, 0.0), (1, 0.0), (8, 5.0)]
    with pytest.raises(ValueError):
        metric.build_vector_index(spark.createDataFrame(rows[2:5], SCHEMA), scratch_path(spark, "vectors"), 1.0)
