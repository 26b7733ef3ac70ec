"""Convex hulls of many groups at once, and their diameters.

Hulls merge: the hull of a group is the hull of the hulls of its parts. One aggregate finds each group's farthest points in
eight directions, and points well inside that octagon go. Groups that are still large are dealt into parts, each part is
reduced to its hull in a task of its own, and the parts of a group are merged in ever fewer parts, so neither a hot group nor a
great many small ones meet in one task. A group whose hull itself is larger than a part goes through ``convex_hull``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geometry import cross, usable
from lodestar.operators.hull import BAND, EDGE, convex_hull, hull_diameter
from lodestar.session import local_frame, written

#: Points of a group that one task reduces to their hull.
PART = 20_000

#: A round must leave at most this share of a group's points, or its hull is as large as that.
PROGRESS = 0.5


def _directions() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [x, x + y, y, y - x, -x, -x - y, -y, x - y]


def _outer(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct points of each group on or beyond its octagon of extremes."""
    picks = [F.max_by(axis, along).alias(f"_{axis}{i}") for i, along in enumerate(_directions()) for axis in ("x", "y")]
    rings = written(points.groupBy(*keys).agg(*picks), "rings")
    ring = [(F.col(f"_x{i}"), F.col(f"_y{i}")) for i in range(8)]
    band = BAND * (ring[0][0] - ring[4][0]) * (ring[2][1] - ring[6][1])
    outside = [
        ((a[0] != b[0]) | (a[1] != b[1])) & (cross(*a, *b, "x", "y") <= band) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)
    ]
    one_place = reduce(lambda p, q: p & q, [(ring[0][0] == c[0]) & (ring[0][1] == c[1]) for c in ring[1:]])
    met = points.join(rings, reduce(lambda p, q: p & q, [points[k].eqNullSafe(rings[k]) for k in keys]))
    met = met.filter(reduce(lambda p, q: p | q, outside) | one_place)
    return met.select(*[points[k] for k in keys], "x", "y").distinct()


def _ring_of() -> Callable[[np.ndarray], list[tuple[float, float]]]:
    """What orders the hull of a few points counter-clockwise. Inner functions travel by value to executors."""

    def ring(places: np.ndarray) -> list[tuple[float, float]]:
        rows = sorted(set(map(tuple, (places + 0.0).tolist())))
        if len(rows) < 3:
            return rows
        whole: list[tuple[float, float]] = []
        for side in (rows, rows[::-1]):
            begin = len(whole)
            for p in side:
                while len(whole) > begin + 1:
                    (ax, ay), (bx, by) = whole[-2:]
                    if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                        break
                    whole.pop()
                whole.append(p)
            whole.pop()
        return whole

    return ring


def _reducer(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    ring = _ring_of()

    def reduce_part(part: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(ring(part[["x", "y"]].to_numpy(float)), columns=["x", "y"])
        for i, key in enumerate(keys):
            out.insert(i, key, [part[key].iloc[0]] * len(out))
        return out

    return reduce_part


def _edge_maker(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    ring = _ring_of()

    def edges(group: pd.DataFrame) -> pd.DataFrame:
        places = ring(group[["x", "y"]].to_numpy(float))
        out = pd.DataFrame([(*a, *b) for a, b in zip(places, places[1:] + places[:1])], columns=["ax", "ay", "bx", "by"])
        for i, key in enumerate(keys):
            out.insert(i, key, [group[key].iloc[0]] * len(out))
        return out

    return edges


def group_hulls(points: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """``(keys, ax, ay, bx, by)``: the edges of each group's hull, as ``convex_hull`` gives them for one.

    Groups without a usable point have no edges; a null key is a group like any other.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    left = written(_outer(points.filter(usable()).select(*keys, "x", "y"), keys), "outer")
    same = lambda a, b: reduce(lambda p, q: p & q, [a[k].eqNullSafe(b[k]) for k in keys])
    before, stuck = None, None
    while True:
        sizes = written(left.groupBy(*keys).agg(F.count("*").alias("_n")), "sizes")
        large = sizes.filter(F.col("_n") > part)
        if before is not None:
            # A hull that a round hardly shrank stays that large.
            was = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_n").alias("_was"))
            slow = large.join(was, reduce(lambda p, q: p & q, [large[k].eqNullSafe(was[f"_{k}"]) for k in keys]))
            stuck = written(slow.filter(F.col("_n") > PROGRESS * F.col("_was")).select(*keys), "stuck")
            large = large.join(stuck, same(large, stuck), "left_anti")
        if large.isEmpty():
            break
        big = large.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / part).alias("_parts"))
        met = left.join(big, reduce(lambda p, q: p & q, [left[k].eqNullSafe(big[f"_{k}"]) for k in keys]), "left")
        dealt = met.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.coalesce("_parts", F.lit(1)))).select(*keys, "x", "y", "_part")
        left, before = written(dealt.groupBy(*keys, "_part").applyInPandas(_reducer(keys), f"{ddl}x double, y double"), "part-hulls"), sizes
    few = left if stuck is None else left.join(stuck, same(left, stuck), "left_anti")
    edges = written(few.groupBy(*keys).applyInPandas(_edge_maker(keys), f"{ddl}ax double, ay double, bx double, by double"), "group-hulls")
    for row in stuck.collect() if stuck is not None else []:
        own = left.filter(reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys]))
        named = convex_hull(own.select("x", "y")).select(*[F.lit(row[k]).cast(kinds[k]).alias(k) for k in keys], *EDGE)
        edges = edges.unionByName(named)
    return edges


def group_measures(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, vertices, area)`` of each hull."""
    twice = (F.col("ax") * F.col("by")) - (F.col("bx") * F.col("ay"))
    return edges.groupBy(*keys).agg(F.count("*").alias("vertices"), (F.sum(twice) / 2).alias("area"))


def group_diameters(edges: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """``(keys, diameter)``: the largest distance within each group."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    large = edges.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > part).select(*keys).collect()

    def widest(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group["ax"].to_numpy(), group["ay"].to_numpy()
        far = max(float(np.sqrt((x - x[i]) * (x - x[i]) + (y - y[i]) * (y - y[i])).max()) for i in range(len(x)))
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), far]], columns=[*keys, "diameter"])

    own = lambda row: reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys])
    few = edges
    for row in large:
        few = few.filter(~own(row))
    found = few.groupBy(*keys).applyInPandas(widest, f"{ddl}diameter double")
    for row in large:
        value = hull_diameter(edges.filter(own(row)).select(*EDGE)).first()[0]
        found = found.unionByName(local_frame(edges.sparkSession, [(*(row[k] for k in keys), value)], f"{ddl}diameter double"))
    return found
