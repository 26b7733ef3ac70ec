"""The four quadrants around the centroid: area, count and density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.constants import LOWER_LEFT, LOWER_RIGHT, QUADRANTS, UPPER_LEFT, UPPER_RIGHT
from lodestar.functions.geometry import Location, quadrant_of, usable


def quadrant_areas(min_x, max_x, min_y, max_y, cx, cy) -> dict[str, Column]:
    """Areas of the rectangles into which the centroid cuts the bounding box."""
    left, right, lower, upper = cx - min_x, max_x - cx, cy - min_y, max_y - cy
    areas = {
        UPPER_LEFT: left * upper,
        UPPER_RIGHT: right * upper,
        LOWER_RIGHT: right * lower,
        LOWER_LEFT: left * lower,
    }
    return {name: area if isinstance(area, Column) else F.lit(area) for name, area in areas.items()}


def quadrant_counts(points: DataFrame, centre: Location) -> DataFrame:
    """Points per quadrant, four rows even where a quadrant is empty. Each task sends one row."""
    place = quadrant_of("x", "y", centre)
    counts = points.filter(usable()).agg(*(F.count_if(place == name).alias(name) for name in QUADRANTS))
    return _as_rows(counts)


def stored_quadrant_counts(indexed: DataFrame) -> DataFrame:
    """``quadrant_counts`` from a stored quadrant column: only that column is read."""
    return _as_rows(indexed.agg(*(F.count_if(F.col("quadrant") == name).alias(name) for name in QUADRANTS)))


def _as_rows(counts: DataFrame) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in QUADRANTS))
    return counts.select(F.inline(rows))


def quadrant_table(counts: DataFrame, areas: dict[str, Column]) -> DataFrame:
    """``(name, area, n, density)``; the density of a quadrant without area is null."""
    area = F.lit(None).cast("double")
    for name, value in areas.items():
        area = F.when(F.col("name") == name, value).otherwise(area)
    return counts.select(
        "name", area.alias("area"), "n", F.try_divide(F.col("n").cast("double"), area).alias("density")
    )


def plain_quadrants(counts: dict[str, int], extent) -> dict[str, dict]:
    """``quadrant_table`` of known counts over an extent, on the driver."""
    left, right = extent.cx - extent.min_x, extent.max_x - extent.cx
    lower, upper = extent.cy - extent.min_y, extent.max_y - extent.cy
    areas = {UPPER_LEFT: left * upper, UPPER_RIGHT: right * upper, LOWER_RIGHT: right * lower, LOWER_LEFT: left * lower}
    return {
        name: {"name": name, "area": areas[name], "n": counts[name], "density": counts[name] / areas[name] if areas[name] else None}
        for name in QUADRANTS
    }
