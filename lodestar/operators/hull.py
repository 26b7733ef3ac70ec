"""Convex hull, and what follows from it: diameter, area and centroid.

The hull is kept as a table of directed edges ``(ax, ay, bx, by)``, counter-clockwise. Area and centroid are
then plain sums over the edges, and no step ever needs the whole ring in order.

Two scans of the points and some work on the few outer ones give the edges; where no more than ``SMALL`` points are
left after the second, the driver finishes them:

1. one aggregate finds farthest points in eight directions;
2. a filter over literals drops every point well inside that octagon; the rest is made distinct and written;
3. what is left falls into four pockets beyond the quadrilateral of axis extremes. A pocket with more than
   ``pocket_limit`` points is split at its farthest point, round by round, with ordinary aggregates and joins.
   Pockets that fit are finished independently of each other.

No task, and not the driver either, ever holds more than ``pocket_limit`` points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.geometry import Location, cross, cross_text, distance, number_text, usable
from lodestar.session import local_frame, written

POCKET_LIMIT = 100_000

#: Up to so many outer points, or edges, are finished by the driver in one go. Beyond that everything stays in tasks; the
#: result is the same.
SMALL = 4096

EDGE = ["ax", "ay", "bx", "by"]
EDGE_SCHEMA = ", ".join(f"{name} double" for name in EDGE)

# Relative width of the band along the octagon that rounding could affect; points in it are kept.
BAND = 1e-9


@dataclass(frozen=True)
class Extremes:
    """Extreme points of the data, and what the same scan counts.

    ``ring`` lists a farthest point in each of eight directions, counter-clockwise from the east. ``first`` is
    the first point ``(uid, x, y)`` by uid, found along the way where uids are integers.
    """

    n: int
    ring: tuple[Location, ...] = ()
    first: tuple | None = None

    @property
    def min_x(self) -> float:
        return self.ring[4].x

    @property
    def max_x(self) -> float:
        return self.ring[0].x

    @property
    def min_y(self) -> float:
        return self.ring[6].y

    @property
    def max_y(self) -> float:
        return self.ring[2].y


def extremes(points: DataFrame) -> Extremes:
    """One scan: how many usable points there are, and a farthest one in each of eight directions.

    Only numbers are aggregated, never structs, so this is a hash aggregate in generated code. The x and y of
    one direction come from the same row, since both follow the same comparisons.
    """
    x, y = F.col("x"), F.col("y")
    directions = [
        (F.max_by, x),
        (F.max_by, x + y),
        (F.max_by, y),
        (F.min_by, x - y),
        (F.min_by, x),
        (F.min_by, x + y),
        (F.min_by, y),
        (F.max_by, x - y),
    ]
    sums = [F.count("*")] + [pick(axis, measure) for pick, measure in directions for axis in (x, y)]
    numbered = dict(points.dtypes).get("uid") in ("int", "bigint")
    if numbered:
        sums += [F.min("uid"), F.min_by(x, "uid"), F.min_by(y, "uid")]
    n, *found = points.filter(usable()).agg(*(value.alias(f"v{i}") for i, value in enumerate(sums))).first()
    if not n:
        return Extremes(0)
    ring = tuple(Location(found[i], found[i + 1]) for i in range(0, 16, 2))
    return Extremes(n, ring, tuple(found[16:]) if numbered else None)


def convex_hull(points: DataFrame, found: Extremes | None = None, pocket_limit: int = POCKET_LIMIT, small: int = SMALL) -> DataFrame:
    """Edges of the convex hull, counter-clockwise, collinear points left out.

    One distinct point gives one edge from it to itself, collinear points give one edge each way, no points
    give no edges.
    """
    spark = points.sparkSession
    found = found or extremes(points)
    if not found.n:
        return local_frame(spark, [], EDGE_SCHEMA)
    outer = written(_outer_points(points, found), "hull-outer")
    few = _if_few(outer, small)
    if few is not None:
        return local_frame(spark, _ring([tuple(row) for row in few]), EDGE_SCHEMA)
    corners = _corners(outer)
    sides = [(a, b) for a, b in zip(corners, corners[1:] + corners[:1]) if a != b]
    if not sides:
        return local_frame(spark, [(*corners[0], *corners[0])], EDGE_SCHEMA)

    pockets = _pockets(outer, sides)
    sizes = {tuple(row[:4]): row["count"] for row in pockets.groupBy(*EDGE).count().collect()}
    bare = [(*a, *b) for a, b in sides if (*a, *b) not in sizes]
    edges = local_frame(spark, bare, EDGE_SCHEMA)
    largest = max(sizes.values(), default=0)
    while largest > pocket_limit:
        pockets, closed = _split(pockets)
        edges = edges.unionByName(closed)
        largest = pockets.groupBy(*EDGE).count().agg(F.max("count")).first()[0] or 0
    if sizes:
        edges = edges.unionByName(pockets.groupBy(*EDGE).applyInPandas(_pocket_finisher(), EDGE_SCHEMA))
    return written(edges, "hull-edges")


def _if_few(df: DataFrame, most: int) -> list | None:
    """All rows, if there are at most so many."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _ring(places: list[tuple[float, float]]) -> list[tuple]:
    """Edges of the hull of a few distinct points."""
    places = sorted((x + 0.0, y + 0.0) for x, y in places)
    if len(places) == 1:
        return [(*places[0], *places[0])]
    vertices: list[tuple[float, float]] = []
    for side in (places, places[::-1]):
        start = len(vertices)
        for p in side:
            while len(vertices) > start + 1 and _turn(vertices[-2], vertices[-1], p) <= 0:
                vertices.pop()
            vertices.append(p)
        vertices.pop()
    return [(*a, *b) for a, b in zip(vertices, vertices[1:] + vertices[:1])]


def _turn(a, b, p) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _outer_points(points: DataFrame, found: Extremes) -> DataFrame:
    """Distinct points on or beyond the octagon of extremes: a filter over literals, and a partial distinct."""
    band = number_text(BAND * (found.max_x - found.min_x) * (found.max_y - found.min_y))
    ring = [p for i, p in enumerate(found.ring) if p != found.ring[i - 1]]
    outer = [f"{cross_text(a, b)} <= {band}" for a, b in zip(ring, ring[1:] + ring[:1])]
    points = points.filter(usable())
    if len(ring) > 2:
        points = points.filter(" OR ".join(outer))
    return points.select("x", "y").distinct()


def _corners(outer: DataFrame) -> list[Location]:
    """Axis extremes east, north, west and south. Ties go to the outer end, so each is a vertex of the hull."""
    by_x, by_y = F.struct("x", "y"), F.struct("y", "x")
    row = outer.agg(F.max(by_x).alias("e"), F.max(by_y).alias("n"), F.min(by_x).alias("w"), F.min(by_y).alias("s"))
    row = row.first()
    return [Location(row[name]["x"], row[name]["y"]) for name in ("e", "n", "w", "s")]


def _pockets(outer: DataFrame, sides: list[tuple[Location, Location]]) -> DataFrame:
    """Points outside the quadrilateral of axis extremes, each with the side it lies beyond."""
    cases = []
    for a, b in sides:
        edge = ", ".join(f"'{name}', {number_text(v)}" for name, v in zip(EDGE, (*a, *b)))
        cases.append(f"WHEN {cross_text(a, b)} < 0 THEN named_struct({edge})")
    sided = outer.selectExpr(f"CASE {' '.join(cases)} END AS side", "x", "y")
    return sided.filter("side IS NOT NULL").select("side.*", "x", "y")


def _split(pockets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split every pocket at its farthest point: the two smaller pockets' points, and sides that are done."""
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    depth = -cross(*a, *b, "x", "y")
    along = (b[0] - a[0]) * (F.col("x") - a[0]) + (b[1] - a[1]) * (F.col("y") - a[1])
    far = pockets.groupBy(*EDGE).agg(F.max(F.struct(depth, along, "x", "y")).alias("far"))
    far = written(far.select(*EDGE, F.col("far.x").alias("cx"), F.col("far.y").alias("cy")), "hull-far")
    c = (F.col("cx"), F.col("cy"))
    first = F.struct(*(v.alias(name) for v, name in zip((*a, *c), EDGE)))
    second = F.struct(*(v.alias(name) for v, name in zip((*c, *b), EDGE)))
    side = F.when(cross(*a, *c, "x", "y") < 0, first).when(cross(*c, *b, "x", "y") < 0, second)
    smaller = (
        pockets.join(far, EDGE)
        .select(side.alias("side"), "x", "y")
        .filter(F.col("side").isNotNull())
        .select("side.*", "x", "y")
    )
    smaller = written(smaller, "hull-pockets")
    made = far.select(F.explode(F.array(first, second)).alias("side")).select("side.*")
    return smaller, made.join(smaller.select(*EDGE).distinct(), EDGE, "left_anti")


def _pocket_finisher() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What finishes one pocket. An inner function travels by value, so executors need no copy of this package."""

    def turn(a, b, p) -> float:
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def finish(pocket: pd.DataFrame) -> pd.DataFrame:
        """The chain of hull edges around a pocket, whose points are few enough for one task."""
        ax, ay, bx, by = (float(pocket[name].iloc[0]) for name in EDGE)
        x_sign = (bx > ax) - (bx < ax)
        y_sign = (by > ay) - (by < ay)
        places = sorted(zip(pocket["x"], pocket["y"]), key=lambda p: (x_sign * p[0], y_sign * p[1]))
        chain = [(ax, ay)]
        for p in [*places, (bx, by)]:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        return pd.DataFrame([(*u, *v) for u, v in zip(chain, chain[1:])], columns=EDGE)

    return finish


def hull_vertices(edges: DataFrame) -> DataFrame:
    """Vertices of the hull; each starts exactly one edge."""
    return edges.select(F.col("ax").alias("x"), F.col("ay").alias("y"))


def hull_diameter(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Largest distance between two hull vertices, hence between any two points: one row.

    Up to ``small`` edges are compared with one another. Beyond that:

    The farthest pair is antipodal, so for each edge it is enough to look at the edge that lies opposite: the
    last one, in order of direction, whose direction does not exceed the reverse of this edge's. That is an
    as-of match by direction over range partitions, so edges that share almost one direction still spread.
    """
    few = _if_few(hull_vertices(edges), small)
    if few is not None:
        return local_frame(edges.sparkSession, [(_widest(np.array(few, float).reshape(-1, 2)),)], "diameter double")
    placed, before = _by_direction(edges)
    upto = Window.partitionBy("part").orderBy("dir", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = F.last(F.when(F.col("asks") == 0, F.col("edge")), ignorenulls=True).over(upto)
    pairs = placed.withColumn("met", met).filter(F.col("asks") == 1).join(before, "part")
    pairs = pairs.withColumn("met", F.coalesce("met", "before"))

    def apart(p, q):
        return distance(F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{q}x"), F.col(f"{q}y"))

    widest = F.greatest(
        apart("edge.a", "edge.b"),
        apart("edge.a", "met.a"),
        apart("edge.a", "met.b"),
        apart("edge.b", "met.a"),
        apart("edge.b", "met.b"),
    )
    return pairs.agg(F.max(widest).alias("diameter"))


def _widest(places: np.ndarray) -> float | None:
    """Largest distance within a few points."""
    apart = [np.sqrt((places[:, 0] - x) ** 2 + (places[:, 1] - y) ** 2).max() for x, y in places]
    return float(max(apart)) if apart else None


def _by_direction(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (``asks`` 0) and the reverses they ask for (``asks`` 1), range-partitioned by direction; and per
    partition the last edge that stands ``before`` it, going round: one row for each partition."""
    ring = edges.select(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("dir"), F.struct(*EDGE).alias("edge"))
    opposite = F.col("dir") + F.when(F.col("dir") <= 0, F.lit(math.pi)).otherwise(F.lit(-math.pi))
    rows = ring.select("dir", F.lit(0).alias("asks"), "edge").unionByName(
        ring.select(opposite.alias("dir"), F.lit(1).alias("asks"), "edge")
    )
    placed = written(rows.repartitionByRange("dir", "asks").withColumn("part", F.spark_partition_id()), "directions")
    last = F.max_by("edge", F.when(F.col("asks") == 0, F.col("dir")))
    ends = placed.groupBy("part").agg(last.alias("last"))
    line = Window.orderBy("part")
    earlier = F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    round_again = F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return placed, ends.select("part", F.coalesce(earlier, round_again).alias("before"))


def hull_measures(edges: DataFrame, anchor: Location = Location(0.0, 0.0)) -> DataFrame:
    """Area and centroid of the hull: one row ``(area, cx, cy, vertices)``.

    Sums over edges, taken relative to ``anchor`` to keep digits. A hull without area has the middle of its
    vertices as centroid.
    """
    ax, ay = F.col("ax") - F.lit(anchor[0]), F.col("ay") - F.lit(anchor[1])
    bx, by = F.col("bx") - F.lit(anchor[0]), F.col("by") - F.lit(anchor[1])
    twice = ax * by - bx * ay
    sums = edges.agg(
        F.sum(twice).alias("twice"),
        F.sum((ax + bx) * twice).alias("mx"),
        F.sum((ay + by) * twice).alias("my"),
        F.avg("ax").alias("mean_x"),
        F.avg("ay").alias("mean_y"),
        F.count("*").alias("vertices"),
    )
    flat = F.col("twice") <= 0
    return sums.select(
        (F.col("twice") / 2).alias("area"),
        F.when(flat, F.col("mean_x")).otherwise(F.lit(anchor[0]) + F.try_divide("mx", 3 * F.col("twice"))).alias("cx"),
        F.when(flat, F.col("mean_y")).otherwise(F.lit(anchor[1]) + F.try_divide("my", 3 * F.col("twice"))).alias("cy"),
        "vertices",
    )


def diameter(points: DataFrame) -> DataFrame:
    """Largest distance between any two points: one row, null without points."""
    return hull_diameter(convex_hull(points))


def envelope(points: DataFrame) -> DataFrame:
    """Bounding box: one row ``(min_x, max_x, min_y, max_y)``."""
    return points.filter(usable()).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )
