"""Synthetic points. Seeded: the same arguments give the same points, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import GEO_X_HIGH, GEO_X_LOW, GEO_Y_HIGH, GEO_Y_LOW, UNIFORM_POINTS

# Hexadecimal digits of a hash that make a fraction, and the bits they hold.
FRACTION_DIGITS = 13
FRACTION_BITS = 4 * FRACTION_DIGITS


def fraction(seed: int, *keys) -> Column:
    """Uniform number in [0, 1) from a hash of the keys, so a recomputed task draws the same numbers."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *keys)), 1, FRACTION_DIGITS)
    return F.conv(digits, 16, 10).cast("long").cast("double") * F.lit(2.0**-FRACTION_BITS)


def uniform_points(rows: DataFrame, low: float, high: float, seed: int, key: str = "id") -> DataFrame:
    """A point in the square [low, high) for each row of a table with a key."""
    width = F.lit(float(high - low))
    return rows.select(
        F.col(key).alias("uid"),
        (fraction(seed, key, F.lit("x")) * width + F.lit(float(low))).alias("x"),
        (fraction(seed, key, F.lit("y")) * width + F.lit(float(low))).alias("y"),
    )


def gen_uniform(spark: SparkSession, low: float, high: float, seed: int, n: int = UNIFORM_POINTS) -> DataFrame:
    return uniform_points(spark.range(n), low, high, seed)


def geo_points(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """A point in the fixed geographic window for each row of a table with a key."""
    return rows.select(
        F.col(key).alias("uid"),
        (-(fraction(seed, key, F.lit("x")) * F.lit(GEO_X_HIGH - GEO_X_LOW) + F.lit(GEO_X_LOW))).alias("x"),
        (fraction(seed, key, F.lit("y")) * F.lit(GEO_Y_HIGH - GEO_Y_LOW) + F.lit(GEO_Y_LOW)).alias("y"),
    )


def gen_geo(spark: SparkSession, path: str, n: int, seed: int) -> None:
    """Write n ``i x y`` lines."""
    line = F.concat_ws(" ", "uid", "x", "y")
    geo_points(spark.range(n), seed).select(line.alias("value")).write.mode("overwrite").text(path)
