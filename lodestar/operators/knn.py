"""Nearest neighbours.

Top-k over a large table is a top-k per task plus a merge, and the merge grows with k times the number of
tasks. Where one task cannot merge that, the k-th distance is bounded first: one aggregate counts points per distance
band (a few hundred rows at most per task), and only points up to the band in which the count reaches k are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geometry import Location, distance_to, plain_distance, usable
from lodestar.operators.ordering import by_distance, first_rows, merges_directly
from lodestar.operators.search import EXCLUDE_COORDS, without_query
from lodestar.session import local_frame

# Distance bands per doubling of the distance.
BANDS = 8

# So many neighbours may come to the driver.
FEW = 10_000

# Band of distance zero, below that of the smallest number.
ZERO_BAND = -(1 << 20)


def knn(points: DataFrame, q: Location, k: int, exclude: str = EXCLUDE_COORDS, uid=None) -> DataFrame:
    """The k nearest points by a full scan: ``(uid, x, y, dist)``, nearest first, ties by uid."""
    near = points.filter(usable()).withColumn("dist", distance_to(q))
    return nearest_rows(without_query(near, q, exclude, uid).select("uid", "x", "y", "dist"), k)


def nearest_rows(near: DataFrame, k: int) -> DataFrame:
    """The k rows with the smallest ``dist``, ties by uid."""
    if k <= 0 or merges_directly(near, k):
        return by_distance(near).limit(max(k, 0))
    return _cut(near, _bands(near), k)


def knn_expanding(
    search: Callable[[float], DataFrame], k: int, first_radius: float, last_radius: float
) -> DataFrame:
    """The k nearest points by range searches of growing radius, nearest first, ties by uid.

    ``search(r)`` gives all neighbours within r, ``last_radius`` is one that covers everything. A few neighbours come
    to the driver straight away, and if the first radius held k they are the result: one job. Otherwise each round is
    one pruned aggregate; the final sort sees little more than k rows.
    """
    r = min(first_radius, last_radius)
    if k <= 0:
        return search(0.0).limit(0)
    if k <= FEW:
        near = search(r)
        rows = [tuple(row) for row in by_distance(near).limit(k).collect()]
        if len(rows) == k or r >= last_radius:
            return local_frame(near.sparkSession, rows, near.schema)
    while True:
        near = search(r)
        bands = _bands(near)
        total = sum(count for count, _ in bands)
        if total >= k or r >= last_radius:
            return _cut(near, bands, k)
        step = math.sqrt(k / total) * 1.1 if total else 0.0
        r = min(max(r * 2, r * step), last_radius) if r > 0 else last_radius


def covering_radius(corners: list[Location], q: Location) -> float:
    """A radius around q that holds the whole bounding box."""
    return max(plain_distance(q, corner) for corner in corners) * (1 + 1e-9)


def _bands(near: DataFrame) -> list[tuple[int, float]]:
    """Count and largest distance per band, nearest band first; the number of bands does not grow with the data."""
    band = F.coalesce(F.floor(F.log2("dist") * BANDS), F.lit(ZERO_BAND))
    rows = near.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect()
    return [(row["n"], row["far"]) for row in sorted(rows, key=lambda row: row["band"])]


def _cut(near: DataFrame, bands: list[tuple[int, float]], k: int) -> DataFrame:
    """The k nearest, given the bands."""
    kept = 0
    for count, far in bands:
        kept += count
        if kept >= k:
            near = near.filter(F.col("dist") <= F.lit(far))
            break
    # Within the cut every task still keeps k rows at most, however many share the last distance.
    return first_rows(near, k, ["dist", "uid"])
