"""Whole jobs: from a point file to an index, and on to a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.pivots import distance_map
from lodestar.plans.index import LandmarkIndex, build_index
from lodestar.sources.text import load_points
from lodestar.sources.topics import publish_points


def import_points(
    spark: SparkSession, source: str, path: str, file_order: bool = False, partitions: int | None = None, **options
) -> LandmarkIndex:
    """Load a point file, store it as Parquet, and build its index under ``path``.

    The text is parsed once; the passes of the index build read three Parquet columns. Pivots are chosen in
    order of uid, which is text, or in the order of the lines. ``options`` go to ``load_points``: positions, and
    ``quarantine`` for lines that cannot be read.
    """
    points = load_points(spark, source, **options)
    if file_order:
        points = points.withColumn("line", F.substring_index("uid", "_", -1).cast("bigint"))
    points.write.mode("overwrite").parquet(f"{path}/source")
    stored = spark.read.parquet(f"{path}/source")
    return build_index(stored, path, order_by="line" if file_order else "uid", partitions=partitions)


def publish_index(index: LandmarkIndex, options: dict[str, str]) -> None:
    """Send every stored point, with its pivot distances, to a topic."""
    publish_points(index.points, options, distance_map(index.pivots))


def write_neighbours(found: DataFrame, path: str | None, shown: int) -> None:
    """Store a result, or show its first rows."""
    if path:
        found.write.mode("errorifexists").parquet(path)
    else:
        found.show(shown, truncate=False)
