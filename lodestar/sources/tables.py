"""Catalog tables and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import written


def ensure_table(spark: SparkSession, name: str, schema: str) -> None:
    """Create the table if it is missing."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def recreate_table(spark: SparkSession, name: str, schema: str) -> None:
    """Drop the table if it exists, and create it empty."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    ensure_table(spark, name, schema)


def upserted(base: DataFrame, updates: DataFrame, key: str = "uid", version: str = "ts") -> DataFrame:
    """``base`` (one row per key) with the newest update of each key applied, and new keys added.

    Updates are reduced to one row per key and written first. One full outer join by key then decides everything in
    a single pass over the base. Of equally new updates the greatest row wins; null keys match nothing.
    """
    others = [c for c in base.columns if c != key]
    newest = updates.groupBy(key).agg(F.max(F.struct(version, *[c for c in others if c != version])).alias("_new"))
    newest = written(newest.withColumnRenamed(key, "_key"), "updates")
    held = base.select(key, F.struct(*others).alias("_old"))
    newer = F.col("_old").isNull() | (F.col("_new").isNotNull() & (F.col(f"_new.{version}") >= F.col(f"_old.{version}")))
    met = held.join(newest, F.col(key) == F.col("_key"), "full_outer")
    chosen = [F.when(newer, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in others]
    return met.select(F.coalesce(key, "_key").alias(key), *chosen).select(*base.columns)


def upsert_points(base: DataFrame, updates: DataFrame, path: str) -> DataFrame:
    """Write the merged points as a new snapshot and read it back; the old one stays untouched."""
    spark = base.sparkSession
    upserted(base, updates).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
