"""Keyed cells ``(row, cf, cq, ts, value)``: points, pivots, quadrants and the count as one key-value table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import POINT_COUNT_ROW, QUADRANT_ROW
from lodestar.functions.codec import decode_point, encode_point
from lodestar.operators.lookup import lookup_row, scan_column
from lodestar.plans.index import Extent

CELL_KEY = ["row", "cf", "cq"]
CELL_SCHEMA = "row string, cf string, cq string, ts bigint, value string"


def point_cells(points: DataFrame, ts: Column, distances: Column | None = None) -> DataFrame:
    """One POINT/POJO cell per point; with ``distances`` the value also holds the pivot distances."""
    return points.select(
        F.col("uid").cast("string").alias("row"),
        F.lit("POINT").alias("cf"),
        F.lit("POJO").alias("cq"),
        ts.alias("ts"),
        encode_point(distances=distances).alias("value"),
    )


def mark_cells(marked: DataFrame, qualifier: str, ts: Column, value: Column | None = None) -> DataFrame:
    """ISCANDIDATE or WITHINRANGE marks of the given points."""
    return marked.select(
        F.col("uid").cast("string").alias("row"),
        F.lit("POINT").alias("cf"),
        F.lit(qualifier).alias("cq"),
        ts.alias("ts"),
        (F.lit("TRUE") if value is None else value).alias("value"),
    )


def pivot_cells(pivots: DataFrame, ts: int) -> DataFrame:
    uid = F.col("uid").cast("string")
    value = F.to_json(F.struct("ord", F.col("pivot_id").alias("pivotID"), uid.alias("UID"), "x", "y"))
    return pivots.select(
        F.col("pivot_id").alias("row"),
        F.lit("PIVOT").alias("cf"),
        F.lit("POJO").alias("cq"),
        F.lit(ts).cast("bigint").alias("ts"),
        value.alias("value"),
    )


def read_pivots(cells: DataFrame) -> DataFrame:
    """The pivot table out of its cells."""
    schema = "ord int, pivotID string, UID string, x double, y double"
    pivot = F.from_json("value", schema, {"mode": "FAILFAST"})
    found = scan_column(cells, "PIVOT", "POJO").select(pivot.alias("p"))
    return found.select(F.col("p.pivotID").alias("pivot_id"), "p.ord", F.col("p.UID").alias("uid"), "p.x", "p.y")


def quadrant_cells(quadrants: DataFrame, extent: Extent, ts: int) -> DataFrame:
    """Four quadrant cells and the centroid."""
    name = F.split("name", " ")
    value = F.to_json(F.struct(F.col("n").alias("numObservations"), "area", "density"))
    rows = quadrants.select(name[0].alias("cf"), name[1].alias("cq"), value.alias("value"))
    centre = quadrants.limit(1).select(
        F.lit("CENTROID").alias("cf"),
        F.lit("POINT").alias("cq"),
        F.to_json(F.struct(F.lit(extent.cx).alias("x"), F.lit(extent.cy).alias("y"))).alias("value"),
    )
    return rows.unionByName(centre).select(
        F.lit(QUADRANT_ROW).alias("row"), "cf", "cq", F.lit(ts).cast("bigint").alias("ts"), "value"
    )


def read_quadrant(cells: DataFrame, name: str) -> DataFrame:
    """One quadrant by name, exactly."""
    family, qualifier = name.split(" ")
    schema = "numObservations bigint, area double, density double"
    quadrant = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lookup_row(cells, QUADRANT_ROW, family, qualifier).select(
        F.lit(name).alias("name"), quadrant.alias("q")
    ).select("name", "q.area", F.col("q.numObservations").alias("n"), "q.density")


def read_centroid(cells: DataFrame) -> DataFrame:
    point = decode_point("value")
    return lookup_row(cells, QUADRANT_ROW, "CENTROID", "POINT").select(point.alias("p")).select("p.x", "p.y")


def count_cell(points: DataFrame, ts: int) -> DataFrame:
    """The stored number of points."""
    return points.agg(F.count("*").cast("string").alias("value")).select(
        F.lit(POINT_COUNT_ROW).alias("row"),
        F.lit("DATASET").alias("cf"),
        F.lit("COUNT").alias("cq"),
        F.lit(ts).cast("bigint").alias("ts"),
        "value",
    )


def dataset_count(cells: DataFrame) -> DataFrame:
    return lookup_row(cells, POINT_COUNT_ROW, "DATASET", "COUNT").select(F.col("value").cast("bigint").alias("n"))


def read_points(cells: DataFrame) -> DataFrame:
    """Points out of their cells."""
    decoded = scan_column(cells, "POINT", "POJO").select("row", decode_point("value").alias("p"))
    return decoded.select(F.col("row").alias("uid"), "p.x", "p.y", F.col("p.distancesToPivot").alias("distances"))


def latest_cells(cells: DataFrame) -> DataFrame:
    """The newest version of each key; of equally new ones the greatest value."""
    newest = F.max(F.struct("ts", "value")).alias("newest")
    return cells.groupBy(*CELL_KEY).agg(newest).select(*CELL_KEY, "newest.ts", "newest.value")


def write_cells(cells: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store cells in key order, so that lookups by row skip files and row groups.

    The hash after the key spreads a row with very many cells or versions over several tasks. ``partitions`` is the
    number of files; without it, the session's number of shuffle partitions.
    """
    order = ["row", F.xxhash64("cf", "cq", "ts", "value")]
    spread = cells.repartitionByRange(partitions, *order) if partitions else cells.repartitionByRange(*order)
    spread.sortWithinPartitions(*CELL_KEY).write.mode("overwrite").parquet(path)


def open_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CELL_SCHEMA).parquet(path)
