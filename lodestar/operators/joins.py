"""Many query points at once: distance join and k-nearest-neighbour join over a grid.

The grid halves the bounding box of the points level by level. A query is answered on the level whose cells are about as
wide as its window, so it meets a few cells only: points carry one cell per level in use, queries the cells that their
window touches, and Spark joins the two by cell. Cells with many points or many queries are split on both sides:
each part of the points meets each part of the queries once, in a task of its own. What travels of a point is its
identifier and place.

Nearest neighbours are found from the top of a tree over the points: leaves are runs of equal length in Morton order, each
node knows its box and how many points it holds. The boxes around a query bound how far its k-th neighbour can be, on each
level more closely, and only nodes within that bound are opened. So a query far outside of the data meets a few leaves too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.geometry import distance, spread_bits, usable
from lodestar.operators.ordering import ranked
from lodestar.operators.search import EXCLUDE_COORDS, EXCLUDE_NONE, EXCLUDE_UID, SLACK
from lodestar.session import written

#: Finest level of the grid: so many halvings of the box.
FINEST = 24

#: Rows of one side that one part of a cell holds.
PART_ROWS = 50_000

#: Cells per axis that a window may touch on the level it is answered on, before rounding.
WINDOW_CELLS = 2.0

#: Points of a leaf, at least, and bits of the number of nodes in a node.
LEAF_POINTS = 16
FAN_BITS = 3

#: Pairs of a query and a point that one task of a kNN join compares.
TASK_PAIRS = 2_000_000


def _cells(level: Column) -> Column:
    """Cells per axis."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


@dataclass(frozen=True)
class Grid:
    """A square box that holds all points."""

    x: float
    y: float
    side: float

    @classmethod
    def around(cls, points: DataFrame) -> Grid | None:
        """The grid over all usable points, or None when there are none."""
        found = points.filter(usable()).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]).first()
        if found["min_x"] is None:
            return None
        side = max(found["max_x"] - found["min_x"], found["max_y"] - found["min_y"])
        side = side if math.isfinite(side) and side > 0 else 1.0
        return cls(found["min_x"], found["min_y"], side)

    def cell(self, value: Column, low: float, level: Column) -> Column:
        """Number of the cell along one axis. It never falls as the value grows, and all numbers outside the box
        go to the outermost cells, so a window's cells hold every point of the window."""
        cells = _cells(level)
        place = F.floor((value - F.lit(low)) / F.lit(self.side) * cells).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(cells - 1, place))

    def morton(self) -> Column:
        """Morton number of a point's cell on the finest level."""
        x, y = (spread_bits(self.cell(F.col(axis), low, F.lit(FINEST))) for axis, low in (("x", self.x), ("y", self.y)))
        return x.bitwiseOR(F.shiftleft(y, 1))

    def level(self, window: Column) -> Column:
        """The finest level on which a window of this width touches few cells."""
        fits = F.floor(F.log2(F.lit(WINDOW_CELLS * self.side) / F.greatest(window, F.lit(1e-300))))
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(FINEST), fits)), F.lit(FINEST)).cast("int")


def _windows(queries: DataFrame, grid: Grid) -> DataFrame:
    """Queries with their level, once for each cell that their window touches."""
    # Rounding can only widen the window.
    wide = F.col("r") + SLACK * (1 + F.col("r") + F.abs("qx") + F.abs("qy"))
    box = {
        f"{side}_{axis}": F.least(F.greatest(F.col(f"q{axis}") + sign * wide, F.lit(low)), F.lit(low + grid.side))
        for axis, low in (("x", grid.x), ("y", grid.y))
        for side, sign in (("low", -1), ("high", 1))
    }
    df = queries.withColumns(box)
    df = df.withColumn("level", grid.level(F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"))))
    level = F.col("level")
    for axis, low in (("x", grid.x), ("y", grid.y)):
        ends = [grid.cell(F.col(f"{side}_{axis}"), low, level) for side in ("low", "high")]
        df = df.withColumn(f"c{axis}", F.explode(F.sequence(*ends)))
    return df.select("query_id", "qx", "qy", "r", "level", "cx", "cy")


CELL = ["level", "cx", "cy"]
BOX = ["low_x", "low_y", "high_x", "high_y"]


def _placed(points: DataFrame, grid: Grid, levels: list[int]) -> DataFrame:
    """Points once for each level in use, with their cell there."""
    df = points.filter(usable()).select("uid", "x", "y", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    level = F.col("level")
    return df.withColumns({"cx": grid.cell(F.col("x"), grid.x, level), "cy": grid.cell(F.col("y"), grid.y, level)})


def _parted(side: DataFrame, crowded: DataFrame, own: str, other: str, key: Column) -> DataFrame:
    """Rows with the number of the unit in which they meet the other side. In a crowded cell a row belongs to one of its own
    side's parts and goes to every part of the other side."""
    df = side.join(crowded, CELL, "left")
    mine = F.pmod(F.xxhash64(key), F.col(own))
    each = F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
    row_major = (lambda o: mine * F.col(other) + o) if own == "point_parts" else (lambda o: o * F.col(own) + mine)
    unit = F.when(F.col(own).isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(each, row_major))
    return df.withColumn("unit", F.explode(unit)).drop(own, other)


def range_join(points: DataFrame, queries: DataFrame, r: float | None = None, exclude: str = EXCLUDE_COORDS, grid: Grid | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """All points within a radius of each query point: ``(query_id, uid, x, y, dist)``, exact, in no order.

    ``queries`` has ``query_id, x, y`` and, where ``r`` is not given, a radius ``r`` per query; those with a place or
    radius that is not a finite number, or with a negative radius, find nothing. ``exclude`` as for a single range query:
    points at the query's coordinates, with its identifier, or none are left out.
    """
    radius = F.col("r") if r is None else F.lit(float(r))
    asked = queries.filter(usable()).select("query_id", F.col("x").alias("qx"), F.col("y").alias("qy"), radius.cast("double").alias("r"))
    return _joined(points, asked, exclude, grid, part_rows).select("query_id", "uid", "x", "y", "dist")


def _joined(points: DataFrame, asked: DataFrame, exclude: str, grid: Grid | None, part_rows: int) -> DataFrame:
    """The join, with the queries' places ``qx, qy``."""
    if exclude not in (EXCLUDE_COORDS, EXCLUDE_UID, EXCLUDE_NONE):
        raise ValueError(f"exclude must be coords, uid or none, not {exclude!r}")
    asked = asked.filter((F.col("r") >= 0) & (F.col("r") < float("inf")))
    grid = grid or Grid.around(points) or Grid(0.0, 0.0, 1.0)
    # Written, so that Spark chooses the join by its true size, and the levels are those that are in use.
    windows = written(_windows(asked, grid), "windows")
    levels = sorted(row["level"] for row in windows.select("level").distinct().collect())
    edges = [F.min(F.col(f"q{c}") - F.col("r")) for c in "xy"] + [F.max(F.col(f"q{c}") + F.col("r")) for c in "xy"]
    low_x, low_y, high_x, high_y = (edge or 0.0 for edge in windows.agg(*edges).first())
    wide = SLACK * (1 + max(map(abs, (low_x, low_y, high_x, high_y))))
    inside = F.col("x").between(low_x - wide, high_x + wide) & F.col("y").between(low_y - wide, high_y + wide)
    placed = _placed(points.filter(inside), grid, levels or [0])

    asked_cells = written(windows.groupBy(*CELL).agg(F.count("*").alias("asked")), "asked")
    held = placed.join(asked_cells, CELL).groupBy(*CELL, "asked").agg(F.count("*").alias("held"))
    crowded = held.filter((F.col("held") > part_rows) | (F.col("asked") > part_rows)).select(
        *CELL, F.ceil(F.col("held") / part_rows).alias("point_parts"), F.ceil(F.col("asked") / part_rows).alias("query_parts")
    )
    crowded = written(crowded, "crowded")
    left = _parted(placed, crowded, "point_parts", "query_parts", F.col("uid"))
    right = _parted(windows, crowded, "query_parts", "point_parts", F.struct("query_id", "qx", "qy"))
    found = left.join(right, [*CELL, "unit"]).withColumn("dist", distance("qx", "qy", "x", "y")).filter(F.col("dist") <= F.col("r"))
    if exclude == EXCLUDE_COORDS:
        found = found.filter((F.col("x") != F.col("qx")) | (F.col("y") != F.col("qy")))
    if exclude == EXCLUDE_UID:
        found = found.filter(F.col("uid") != F.col("query_id"))
    return found.select("query_id", "qx", "qy", "uid", "x", "y", "dist")


def pyramid(points: DataFrame, grid: Grid, finest: int) -> DataFrame:
    """``(level, cx, cy, n)``: counts of points per cell on all levels up to ``finest``. Only the finest level reads the
    points; each other one adds up four cells."""
    level = written(_placed(points, grid, [finest]).groupBy(*CELL).agg(F.count("*").alias("n")), "level")
    levels = level
    for coarser in range(finest - 1, -1, -1):
        up = [F.lit(coarser).alias("level"), *[F.shiftright(c, finest - coarser).alias(c) for c in ("cx", "cy")]]
        levels = levels.unionByName(level.groupBy(*up).agg(F.sum("n").alias("n")))
    return levels


def thinned(points: DataFrame, k: int, exclude: str) -> DataFrame:
    """Points without those that cannot be among k nearest: of one place only the k least identifiers can, and as many more
    where one identifier may be left out."""
    if exclude == EXCLUDE_UID:
        same = Window.partitionBy("x", "y", "uid").orderBy("uid")
        points = points.filter("uid IS NOT NULL").withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k)
        k *= 2
    first = Window.partitionBy("x", "y").orderBy("uid")
    return points.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).select("uid", "x", "y")


def tree(points: DataFrame, grid: Grid, leaf: int) -> tuple[DataFrame, list[DataFrame]]:
    """Points with the number of their leaf as ``node``, and the levels of nodes ``(node, low_x, low_y, high_x, high_y, n)`` from
    the leaves up to one with few nodes. The nodes of a node are those whose number without the last bits is its own."""
    placed = ranked(points.withColumn("_z", grid.morton()), ["_z", "x", "y", "uid"], "_at")
    placed = written(placed.select("uid", "x", "y", F.floor(F.col("_at") / leaf).alias("node")), "leaves")
    ends = [F.min("x").alias("low_x"), F.min("y").alias("low_y"), F.max("x").alias("high_x"), F.max("y").alias("high_y")]
    levels = [written(placed.groupBy("node").agg(*ends, F.count("*").alias("n")), "nodes")]
    nodes = levels[0].count()
    while nodes > 1 << FAN_BITS:
        nodes = -(-nodes >> FAN_BITS)
        ends = [(F.min if name.startswith("low") else F.max)(name).alias(name) for name in BOX]
        up = levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(*ends, F.sum("n").alias("n"))
        levels.append(written(up, "nodes"))
    return placed, levels


def _within_reach(opened: DataFrame, need: int) -> DataFrame:
    """Queries and nodes ``(q, qx, qy, node, bound)``, without the nodes that cannot hold one of the ``need`` nearest points.

    No point of a box is nearer than ``near`` or farther than ``far``, in the last bit too: each step of the distance is
    monotone after rounding. Where all the boxes hold too few, nothing bounds them.
    """
    gaps = [(F.col(f"low_{a}") - F.col(f"q{a}"), F.col(f"q{a}") - F.col(f"high_{a}")) for a in "xy"]
    near_x, near_y = (F.greatest(low, high, F.lit(0.0)) for low, high in gaps)
    far_x, far_y = (F.greatest(F.abs(low), F.abs(high)) for low, high in gaps)
    near, far = (F.sqrt(x * x + y * y) for x, y in ((near_x, near_y), (far_x, far_y)))
    nodes = opened.select("q", "qx", "qy", "node", "n", near.alias("near"), far.alias("far"))
    nearest_first = Window.partitionBy("q").orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumn("_held", F.sum("n").over(nearest_first))
    bound = F.min(F.when(F.col("_held") >= need, F.col("far"))).over(Window.partitionBy("q"))
    nodes = nodes.withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))
    return written(nodes.filter(F.col("near") <= F.col("bound")).select("q", "qx", "qy", "node", "bound"), "reach")


def _met(reach: DataFrame, held: DataFrame, part_rows: int, leaf: int | None = None) -> DataFrame:
    """Queries joined by node with what the nodes hold. A node that very many queries reach is lent to each part of them.
    Where leaves of that many points are joined, no task meets more than its share of pairs."""
    asked = reach.groupBy("node").agg(F.count("*").alias("asked")).filter(F.col("asked") > part_rows)
    crowded = written(asked.select("node", F.ceil(F.col("asked") / part_rows).alias("parts")), "crowded")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = reach.join(crowded, "node", "left").withColumn("part", F.pmod(F.xxhash64("q"), parts)).drop("parts")
    if leaf:
        left = left.repartition(-(-reach.count() * leaf // TASK_PAIRS) or 1, "node", "part")
    each = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    return left.join(held.join(crowded, "node", "left").withColumn("part", each).drop("parts"), ["node", "part"])


def knn_join(points: DataFrame, queries: DataFrame, k: int, exclude: str = EXCLUDE_COORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """The k nearest points of each query point: ``(query_id, uid, x, y, dist, rank)``, ranks from 1, ties by uid.

    Every query goes down the tree of the points, level by level, and is compared with the points of the leaves that it
    reaches. One place holds k points at most after thinning, so twice as many are sure to leave k where a query's own place
    is left out. Where an identifier is left out that many points share, queries that found fewer than k go down again
    with a wider bound, until it covers everything. Queries with unusable coordinates find nothing; repeated queries are
    answered once.
    """
    if exclude not in (EXCLUDE_COORDS, EXCLUDE_UID, EXCLUDE_NONE):
        raise ValueError(f"exclude must be coords, uid or none, not {exclude!r}")
    wanted, k = k, max(k, 1)
    points = points.filter(usable()).select("uid", "x", "y")
    grid = Grid.around(points) or Grid(0.0, 0.0, 1.0)
    leaf = max(LEAF_POINTS, k)
    placed, levels = tree(thinned(points, k, exclude), grid, leaf)
    asked = queries.filter(usable()).select("query_id", *[F.col(a).cast("double").alias(f"q{a}") for a in "xy"]).distinct()
    asked = written(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    top = levels[-1].collect()
    roots = F.explode(F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in node.asDict().items()]) for node in top])) if top else None
    order = Window.partitionBy("q").orderBy("dist", "uid")
    need, total, left, rounds = k if exclude == EXCLUDE_NONE else 2 * k, sum(node["n"] for node in top), asked, []
    while True:
        opened = left.select("q", "qx", "qy", roots.alias("_node")).select("q", "qx", "qy", "_node.*") if top else left.limit(0).join(levels[-1])
        reach = _within_reach(opened, need)
        for nodes in reversed(levels[:-1]):
            inner = nodes.withColumnRenamed("node", "_node").withColumn("node", F.shiftright("_node", FAN_BITS))
            opened = _met(reach, inner, part_rows).drop("node", "bound").withColumnRenamed("_node", "node")
            reach = _within_reach(opened, need)
        found = _met(reach, placed, part_rows, leaf).withColumn("dist", distance("qx", "qy", "x", "y")).filter(F.col("dist") <= F.col("bound"))
        if exclude == EXCLUDE_COORDS:
            found = found.filter((F.col("x") != F.col("qx")) | (F.col("y") != F.col("qy")))
        if exclude == EXCLUDE_UID:
            found = found.join(left.select("q", "query_id"), "q").filter(F.col("uid") != F.col("query_id"))
        # Every task hands on k rows a query at most.
        found = found.select("q", "uid", "x", "y", "dist").withColumn("rank", F.row_number().over(order))
        found = written(found.filter(F.col("rank") <= wanted), "round")
        if exclude != EXCLUDE_UID or need >= total:
            rounds.append(found)
            break
        full = written(found.filter(F.col("rank") == k).select("q"), "answered")
        rounds.append(found.join(full, "q", "left_semi"))
        left, need = written(left.join(full, "q", "left_anti"), "unfinished"), need * 8
        if left.isEmpty():
            break
    found = reduce(DataFrame.unionByName, rounds)
    return found.join(asked, "q").select("query_id", "uid", "x", "y", "dist", "rank")
