"""Building, storing and querying a landmark index."""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import ALPHA, PIVOT_PREFIX, QUADRANTS
from lodestar.functions.geometry import Location, derive_range, plain_derive_range, plain_quadrant, quadrant_of, spread_bits, usable
from lodestar.operators import knn as nearest_neighbours
from lodestar.operators import search
from lodestar.operators.hull import Extremes, convex_hull, extremes, hull_diameter, hull_measures
from lodestar.operators.pivots import Pivot, pivot_distances_wide, pivots_frame, sss_pivots
from lodestar.operators.quadrants import plain_quadrants
from lodestar.session import local_frame, together
from lodestar.sources.versions import last_version, publish_version, read_version

# The first radius of a kNN search over the radius that the density suggests: seldom leaves a second round.
FIRST_STEP = 1.3

# Column with the number of the build.
BUILD = "build"

# Points per file of a stored index.
ROWS_PER_FILE = 2_000_000

# Bits per axis of the cell number that orders the stored points.
CELL_BITS = 24

# Level of the finest cells whose points an index counts: 4 ** 6 cells at most.
PYRAMID_LEVEL = 6


@dataclass(frozen=True)
class Extent:
    """Bounding box, hull centroid and area, diameter, and number of points."""

    n: int
    min_x: float
    max_x: float
    min_y: float
    max_y: float
    cx: float
    cy: float
    area: float
    diameter: float

    @property
    def centre(self) -> Location:
        return Location(self.cx, self.cy)

    @property
    def corners(self) -> list[Location]:
        return [Location(x, y) for x in (self.min_x, self.max_x) for y in (self.min_y, self.max_y)]


def measure(points: DataFrame, found: Extremes | None = None) -> Extent | None:
    """Extent of the points, or None when there are none."""
    found = found or extremes(points)
    if not found.n:
        return None
    hull = convex_hull(points, found)
    shape, widest = together(
        hull_measures(hull, Location(found.min_x, found.min_y)).first, hull_diameter(hull).first
    )
    return Extent(
        found.n,
        found.min_x,
        found.max_x,
        found.min_y,
        found.max_y,
        shape["cx"],
        shape["cy"],
        shape["area"],
        widest["diameter"],
    )


@dataclass(frozen=True)
class Pyramid:
    """Counts of points in the cells of a grid over the box, ``2 ** level`` a side. Coarser cells are sums of four."""

    box: tuple[float, float, float, float]
    level: int
    cells: tuple[tuple[int, int, int], ...]

    def radius(self, q: Location, k: int) -> float | None:
        """A radius around q that holds k points, or None when there are fewer.

        From the finest level on it looks at q's cell and the eight around it; when they hold k points, it is the
        distance to their farthest corner.
        """
        counts = np.array(self.cells, np.int64).reshape(-1, 3)
        ends = ((self.box[0], self.box[1]), (self.box[2], self.box[3]))
        for level in range(self.level, -1, -1):
            near, reach = np.ones(len(counts), bool), []
            for axis, (at, (low, high)) in enumerate(zip(q, ends, strict=True)):
                share = (1 << CELL_BITS - level) / ((1 << CELL_BITS) - 1) * (high - low)
                own = min(max(math.floor((at - low) / share), 0), (1 << level) - 1) if share > 0 else 0
                near &= np.abs((counts[:, axis] >> self.level - level) - own) <= 1
                reach.append(max(abs(at - low - (own - 1) * share), abs(low + (own + 2) * share - at)))
            if counts[near, 2].sum() >= k:
                return math.hypot(*reach) * (1 + 1e-9)
        return None


def count_cells(points: DataFrame, box: list[float], level: int = PYRAMID_LEVEL) -> list[list[int]]:
    """``[x cell, y cell, points]`` of the cells that are not empty: at most ``4 ** level`` rows come to the driver."""
    last, size = (1 << CELL_BITS) - 1, CELL_BITS - level
    axes = [F.shiftright(_axis(name, low, high, last), size) for name, low, high in (("x", *box[:2]), ("y", *box[2:]))]
    rows = points.groupBy(axes[0].alias("cx"), axes[1].alias("cy")).agg(F.count("*").alias("n")).collect()
    return sorted([row["cx"], row["cy"], row["n"]] for row in rows)


@dataclass(frozen=True)
class LandmarkIndex:
    """Stored points ``uid, x, y, dp_0.., dp_closest, closest_ord, closest_pivot, quadrant`` and their summary."""

    points: DataFrame
    pivots: list[Pivot]
    extent: Extent
    quadrants: dict[str, dict]
    #: Whether every point is nearer than the spacing to a pivot; updates may add points that are not.
    covered: bool = True
    #: Counts of points by cell, as of the build.
    pyramid: Pyramid | None = None

    def range_query(self, q: Location, r: float, pivot_bounds: bool = False, **options) -> DataFrame:
        """Exact range search. The points stand in cell order, so the box around the disc skips what there is to
        skip; the pivot bounds find the same rows and were measured to cost more than they save in the plane."""
        return search.range_query(self.points, self.pivots if pivot_bounds else [], q, r, **options)

    def certain_hits(self, q: Location, r: float) -> DataFrame:
        return search.certain_hits(self.points, self.pivots, q, r)

    def knn(self, q: Location, k: int, **options) -> DataFrame:
        """k nearest neighbours, starting from a radius that the counts around q say holds k points. (One more is
        asked for, since the point at q itself does not count.)"""
        counted = self.pyramid.radius(q, k + 1) if self.pyramid else None
        return nearest_neighbours.knn_expanding(
            lambda r: self.range_query(q, r, ordered=False, **options),
            k,
            self.initial_range(q, k) * FIRST_STEP if counted is None else counted,
            nearest_neighbours.covering_radius(self.extent.corners, q),
        )

    def initial_range(self, q: Location, k: int) -> float:
        """Radius of the disc expected to hold k points at the density of q's quadrant."""
        return plain_derive_range(k, self.quadrants[self.quadrant_name(q)]["density"])

    def initial_ranges(self, k: int) -> DataFrame:
        """``(uid, r)``: the starting radius around each stored point; null where the density is zero."""
        density = F.lit(None).cast("double")
        for name, summary in self.quadrants.items():
            density = F.when(F.col("quadrant") == name, F.lit(summary["density"])).otherwise(density)
        return self.points.select("uid", derive_range(k, density).alias("r"))

    def quadrant_name(self, q: Location) -> str:
        return plain_quadrant(q, self.extent.centre)

    def pivots_frame(self) -> DataFrame:
        return pivots_frame(self.points.sparkSession, self.pivots, dict(self.points.dtypes)["uid"])

    def quadrants_frame(self) -> DataFrame:
        return _quadrants_frame(self.points.sparkSession, self.quadrants)


def build_index(
    points: DataFrame,
    path: str,
    alpha: float = ALPHA,
    order_by: str = "uid",
    partitions: int | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> LandmarkIndex:
    """Choose pivots, store every point with its pivot distances, and summarise the quadrants.

    Points are stored in Morton order of their cell, so a query disc touches few files and row groups, and
    ties within a cell are spread by a hash, so no place can overload one task. Only identifier, coordinates
    and cell are shuffled; everything else is computed on the way to the files, and the quadrants are counted there.
    ``points`` is scanned several times: store it as Parquet first when it comes from text. The number of files follows
    from the number of points, unless ``partitions`` gives it.

    Every build has a folder of its own, and a new version of the index names it when everything is written, so a
    rebuild that fails leaves the index that was there.
    """
    spark = points.sparkSession
    before = last_version(spark, path)
    found = extremes(points)
    extent = measure(points, found)
    if extent is None:
        raise ValueError("no points with finite coordinates")
    pivots = sss_pivots(points, extent.diameter, alpha, order_by, found)

    extra = [order_by] if order_by not in ("uid", "x", "y") else []
    placed = points.filter(usable()).select("uid", "x", "y", *extra, cell_of(extent).alias("_cell"))
    build = uuid.uuid4().hex
    folder = f"build-{build}/points"
    counts = Observation()
    stored = stored_points(placed, pivots, extent.centre, build, partitions or math.ceil(extent.n / rows_per_file))
    stored.observe(counts, *quadrant_sums()).write.parquet(f"{path}/{folder}")
    box = [extent.min_x, extent.max_x, extent.min_y, extent.max_y]
    content = {
        "build": build,
        "points": folder,
        "manifest": None,
        "order_by": order_by,
        "alpha": alpha,
        "box": box,
        "pyramid": count_cells(spark.read.parquet(f"{path}/{folder}"), box),
        "extent": asdict(extent),
        "pivots": [list(p) for p in pivots],
        "quadrants": plain_quadrants(counts.get, extent),
        "covered": True,
    }
    publish_version(spark, path, before, content)
    return opened_index(spark, path, content)


def quadrant_sums() -> list[Column]:
    """Points per quadrant, to be counted on the way."""
    return [F.count_if(F.col("quadrant") == name).alias(name) for name in QUADRANTS]


def stored_points(placed: DataFrame, pivots: list[Pivot], centre: Location, build: str, files: int) -> DataFrame:
    """Points as they are stored, in so many ranges of cells; ``placed`` has the cell as ``_cell``."""
    placed = placed.repartitionByRange(max(1, files), F.col("_cell"), F.xxhash64("uid")).sortWithinPartitions("_cell")
    return _with_distances(placed.drop("_cell"), pivots, centre).withColumn(BUILD, F.lit(build))


def _with_distances(points: DataFrame, pivots: list[Pivot], centre: Location) -> DataFrame:
    """Distance to each pivot, the closest one, and the quadrant: a narrow projection."""
    options = [F.struct(F.col(f"dp_{p.ord}").alias("dist"), F.lit(p.ord).alias("ord")) for p in pivots]
    near = F.least(*options) if len(options) > 1 else options[0]
    return (
        pivot_distances_wide(points, pivots)
        .withColumn("_near", near)
        .withColumns({"dp_closest": F.col("_near.dist"), "closest_ord": F.col("_near.ord")})
        .withColumns(
            {
                "closest_pivot": F.concat(F.lit(PIVOT_PREFIX), F.col("closest_ord")),
                "quadrant": quadrant_of("x", "y", centre),
            }
        )
        .drop("_near")
    )


def load_index(spark: SparkSession, path: str) -> LandmarkIndex:
    """Open the last version of a stored index.

    Points of another build than the one that the version names are refused.
    """
    return opened_index(spark, path, read_version(spark, path)[1])


def stored_files(spark: SparkSession, path: str, content: dict) -> DataFrame:
    """The stored points of a version, with their build: a folder, or the files of a manifest."""
    if content["manifest"] is None:
        return spark.read.parquet(f"{path}/{content['points']}")
    files = [row["file"] for row in spark.read.parquet(f"{path}/{content['manifest']}").select("file").collect()]
    return spark.read.parquet(*[f"{path}/{file}" for file in files])


def opened_index(spark: SparkSession, path: str, content: dict) -> LandmarkIndex:
    """The index that a version describes."""
    points = stored_files(spark, path, content)
    builds = {(points.select(BUILD).first() or [content["build"]])[0], content["build"]}
    if len(builds) > 1:
        raise ValueError(f"the parts of {path} come from different builds: {builds}")
    pivots = [Pivot(*row) for row in content["pivots"]]
    pyramid = Pyramid(tuple(content["box"]), PYRAMID_LEVEL, tuple(map(tuple, content["pyramid"])))
    return LandmarkIndex(points.drop(BUILD), pivots, Extent(**content["extent"]), content["quadrants"], content["covered"], pyramid)


def _quadrants_frame(spark: SparkSession, quadrants: dict[str, dict]) -> DataFrame:
    rows = [(q["name"], q["area"], q["n"], q["density"]) for q in quadrants.values()]
    return local_frame(spark, rows, "name string, area double, n bigint, density double")


def cell_of(extent: Extent) -> Column:
    """Morton number of the point's cell in a grid over the bounding box; points outside go to the cells at its border."""
    return cell_in(extent.min_x, extent.max_x, extent.min_y, extent.max_y)


def cell_in(min_x: float, max_x: float, min_y: float, max_y: float) -> Column:
    last = (1 << CELL_BITS) - 1
    return spread_bits(_axis("x", min_x, max_x, last)).bitwiseOR(F.shiftleft(spread_bits(_axis("y", min_y, max_y, last)), 1))


def _axis(name: str, low: float, high: float, last: int) -> Column:
    if not (high > low and math.isfinite(high - low)):
        return F.lit(0).cast("long")
    place = F.floor((F.col(name) - low) / (high - low) * last).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(last).cast("long"), place))
