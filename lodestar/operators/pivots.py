"""Choice of pivots, and the distances to them."""

from __future__ import annotations

import math
from os.path import commonprefix
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.constants import ALPHA, PIVOT_PREFIX, RANDOM_PIVOT_DRAWS, RANDOM_PIVOT_POOL
from lodestar.functions.geometry import Location, distance, distance_to, plain_distance, usable
from lodestar.functions.keys import pivot_id
from lodestar.operators.hull import Extremes, extremes
from lodestar.operators.ordering import first_rows
from lodestar.session import local_frame, written
from lodestar.sources.generators import fraction


# Cells per axis of the grid that the choice of pivots looks at.
GRID = 32

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


class Pivot(NamedTuple):
    pivot_id: str
    ord: int
    uid: object
    x: float
    y: float

    @property
    def place(self) -> Location:
        return Location(self.x, self.y)


def most_pivots(alpha: float) -> int:
    """How many points of the plane can lie alpha times the diameter apart (isodiametric inequality)."""
    return int(((1 + alpha) / alpha) ** 2)


def sss_pivots(
    points: DataFrame,
    diameter: float,
    alpha: float = ALPHA,
    order_by: str = "uid",
    found: Extremes | None = None,
) -> list[Pivot]:
    """Sparse spatial selection: a point is a pivot when it is at least alpha * diameter from all before it.

    A rejected point stays rejected, so the next pivot is always the first in order among the survivors. One
    scan brings the first survivor of every cell of a fixed grid, which is enough to name the next pivot, and
    mostly those after it too: a new pivot leaves undecided only cells that its disc cuts, and another scan is
    needed only when such a cell could hold an earlier point than the best one known. The result is exactly
    that of going through the points one by one. ``order_by`` must have no nulls.
    """
    spacing = alpha * diameter
    found = found or extremes(points)
    pivots: list[Pivot] = []

    def choose(uid, x, y) -> Location:
        if len(pivots) >= most_pivots(alpha):
            raise RuntimeError(f"more than {most_pivots(alpha)} pivots: diameter {diameter} is too small for the data")
        pivots.append(Pivot(pivot_id(len(pivots)), len(pivots), uid, x, y))
        return pivots[-1].place

    survivors = points.filter(usable())
    if found.first and order_by == "uid":
        survivors = survivors.filter(_clear_of(choose(*found.first), spacing))
    if spacing == 0 and pivots:
        return pivots
    while True:
        firsts = _first_per_cell(survivors, found, order_by)
        undecided: list[tuple] = []
        while firsts:
            key, point = min((value[:2], value[2:]) for value in firsts.values())
            if undecided and min(undecided) < key:
                break
            place = choose(key[1], *point)
            if spacing == 0:
                return pivots
            survivors = survivors.filter(_clear_of(place, spacing))
            for cell, value in list(firsts.items()):
                if plain_distance(place, value[2:]) < spacing:
                    if not _covered(cell, found, place, spacing):
                        undecided.append(value[:2])
                    del firsts[cell]
        if not undecided:
            return pivots


def _first_per_cell(points: DataFrame, box: Extremes, order_by: str) -> dict[int, tuple]:
    """``{cell: (order, uid, x, y)}`` of the first point in each cell; at most GRID * GRID of them.

    The scan aggregates plain numbers. An order that is not a number is first reduced to one that never decreases
    along it; only points that share the least number of their cell are then compared as they are.
    """
    if not box.n:
        return {}

    def axis(name: str, low: float, high: float) -> Column:
        if high == low:
            return F.lit(0)
        return F.least(F.floor((F.col(name) - low) / (high - low) * GRID).cast("int"), F.lit(GRID - 1))

    cell = axis("x", box.min_x, box.max_x) * GRID + axis("y", box.min_y, box.max_y)
    types = dict(points.dtypes)
    if order_by == "uid" and types["uid"] in NUMBERS:
        rows = points.groupBy(cell.alias("cell")).agg(F.min("uid"), F.min_by("x", "uid"), F.min_by("y", "uid")).collect()
        return {row[0]: (row[1], *row[1:]) for row in rows}
    code = F.col(order_by) if types[order_by] in NUMBERS else _text_code(points, order_by)
    coded = points.withColumns({"_cell": cell, "_code": code})
    least = [tuple(row) for row in coded.groupBy("_cell").agg(F.min("_code").alias("_code")).collect()]
    winners = local_frame(points.sparkSession, least, coded.select("_cell", "_code").schema)
    first = F.min(F.struct(F.col(order_by).alias("_order"), F.col("uid").alias("_uid"), "x", "y"))
    found = coded.join(winners, ["_cell", "_code"]).groupBy("_cell").agg(first).collect()
    return {row[0]: tuple(row[1]) for row in found}


def _text_code(points: DataFrame, column: str) -> Column:
    """A number that never decreases along the text: the seven bytes after what all values begin with."""
    ends = points.agg(F.min(column), F.max(column)).first()
    start = len(commonprefix([str(end or "").encode() for end in ends]))
    following = F.hex(F.substring(F.col(column).cast("string").cast("binary"), start + 1, 7))
    return F.conv(F.rpad(following, 14, "0"), 16, 10).cast("long")


def _covered(cell: int, box: Extremes, place: Location, spacing: float) -> bool:
    """Whether every point of the cell is surely nearer to ``place`` than ``spacing``."""
    reach = []
    for index, low, high, at in (
        (cell // GRID, box.min_x, box.max_x, place.x),
        (cell % GRID, box.min_y, box.max_y, place.y),
    ):
        step = (high - low) / GRID
        ends = low + step * (index - 1e-6), low + step * (index + 1 + 1e-6)
        reach.append(max(abs(end - at) for end in ends))
    return plain_distance((0.0, 0.0), reach) < spacing * (1 - 1e-9)


def _clear_of(place: Location, spacing: float) -> Column:
    """At least ``spacing`` from ``place``. The square inside the disc lets the scan skip what is all too near."""
    half = spacing / math.sqrt(2) * (1 - 1e-9)
    x, y = F.col("x"), F.col("y")
    outside = (x <= place.x - half) | (x >= place.x + half) | (y <= place.y - half) | (y >= place.y + half)
    return outside & (distance_to(place) >= F.lit(spacing))


def random_pivots(
    points: DataFrame,
    seed: int,
    draws: int = RANDOM_PIVOT_DRAWS,
    pool: int = RANDOM_PIVOT_POOL,
    order_by: str = "uid",
) -> DataFrame:
    """``draws`` pivots drawn with replacement from the first ``pool`` points.

    The pool is the feature's own, fixed bound, so one window may number it. Draws are hashes of their number.
    """
    order = [order_by] if order_by == "uid" else [order_by, "uid"]
    head = written(first_rows(points.filter(usable()), pool, order), "pivot-pool")
    size = F.lit(head.count())
    drawn = points.sparkSession.range(draws).select(
        F.col("id").cast("int").alias("ord"), F.floor(fraction(seed, "id", F.lit("pivot")) * size).cast("int").alias("_position")
    )
    numbered = head.withColumn("_position", F.row_number().over(Window.orderBy(*order)) - 1)
    return drawn.join(numbered, "_position").select(
        F.concat(F.lit(PIVOT_PREFIX), F.col("ord")).alias("pivot_id"), "ord", "uid", "x", "y"
    )


def pivots_frame(spark: SparkSession, pivots: list[Pivot], uid_type: str = "bigint") -> DataFrame:
    return local_frame(spark, pivots, f"pivot_id string, ord int, uid {uid_type}, x double, y double")


def collect_pivots(frame: DataFrame, alpha: float = ALPHA) -> list[Pivot]:
    """Pivots as driver-side values: no more than geometry allows at their spacing."""
    most = most_pivots(alpha)
    rows = frame.orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"not a pivot table for alpha {alpha}: more than {most} rows")
    return [Pivot(row["pivot_id"], row["ord"], row["uid"], row["x"], row["y"]) for row in rows]


def query_pivot_distances(pivots: DataFrame, q: Location) -> DataFrame:
    """Distance from q to each pivot, nearest first."""
    return pivots.select("pivot_id", "ord", distance_to(q).alias("dist")).orderBy("dist", "ord")


def nearest(pivots: list[Pivot], x="x", y="y") -> Column:
    """Struct ``(dist, ord)`` of the nearest pivot; of equally near ones the first."""
    options = [F.struct(distance(p.x, p.y, x, y).alias("dist"), F.lit(p.ord).alias("ord")) for p in pivots]
    return F.least(*options) if len(options) > 1 else options[0]


def closest_pivot(points: DataFrame, pivots: list[Pivot]) -> DataFrame:
    """Each point with its closest pivot and the distance to it."""
    near = points.withColumn("_near", nearest(pivots))
    return near.select(
        *points.columns,
        F.concat(F.lit(PIVOT_PREFIX), F.col("_near.ord")).alias("closest_pivot"),
        F.col("_near.dist").alias("dp_closest"),
    )


def pivot_distances(points: DataFrame, pivots: list[Pivot]) -> DataFrame:
    """Long form ``(pivot_id, uid, dist)``: every point with every pivot, in one narrow stage and without a join."""
    entries = F.array(
        *(F.struct(F.lit(p.pivot_id).alias("pivot_id"), distance_to(p.place).alias("dist")) for p in pivots)
    )
    return points.select("uid", F.inline(entries)).select("pivot_id", "uid", "dist")


def pivot_distances_wide(points: DataFrame, pivots: list[Pivot]) -> DataFrame:
    """One column ``dp_<i>`` per pivot. Stored as doubles they carry the statistics that pruning needs."""
    return points.withColumns({f"dp_{p.ord}": distance_to(p.place) for p in pivots})


def distance_map(pivots: list[Pivot]) -> Column:
    """The ``dp_<i>`` columns as a map from pivot id to distance."""
    return F.create_map(*(part for p in pivots for part in (F.lit(p.pivot_id), F.col(f"dp_{p.ord}"))))


def write_pivot_maps(distances: DataFrame, path: str) -> None:
    """Store the long form as one folder per pivot. Tasks write what they have: there is no shuffle by pivot."""
    distances.write.mode("overwrite").partitionBy("pivot_id").parquet(path)


def read_pivot_map(spark: SparkSession, path: str, pivot: str) -> DataFrame:
    """The point-to-distance map of one pivot; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("pivot_id") == pivot).select("uid", "dist")


def stored_distance(pivots: list[Pivot], pivot: str) -> Column:
    """The ``dp_<i>`` column that the pivot named in another column of the same row has."""
    missing = F.raise_error(F.concat(F.lit("no stored distance to "), F.col(pivot))).cast("double")
    return F.coalesce(F.try_element_at(distance_map(pivots), F.col(pivot)), missing)


def lookup_pivot_distance(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """Stored distance for each ``(uid, pivot_id)``. A pair without one stops the job instead of counting as 0."""
    missing = F.raise_error(F.concat(F.lit("no stored distance for "), F.concat_ws("_", "pivot_id", "uid")))
    found = pairs.join(distances, ["uid", "pivot_id"], "left")
    return found.withColumn("dist", F.coalesce("dist", missing.cast("double")))
