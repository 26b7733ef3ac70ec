"""Changes to a stored index without building it anew.

A manifest lists the files of the points with their range of cells and what is counted in them. A change rewrites only the
files that hold a changed point or that own the cell of a new one; all others stay where they are. The files and the
manifest of a change are new, and a new version of the index names them at the end: readers go on with the old version until
then, and a change that fails leaves it. Of two changes that begin with the same version, the second to end is refused.

Pivots, centre, the grid of cells and the counts by cell stay those of the build. Searches are exact with any pivots and any box; what can
suffer is how much is skipped. ``covered`` of the index says whether every point is still nearer than the spacing to
a pivot, as a build would have it; when it is not, or after very many changes, build again.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.geometry import usable
from lodestar.operators.pivots import Pivot
from lodestar.operators.quadrants import plain_quadrants
from lodestar.plans.index import ROWS_PER_FILE, Extent, LandmarkIndex, cell_in, opened_index, quadrant_sums, stored_files, stored_points
from lodestar.session import stored_path, written
from lodestar.sources.versions import publish_version, read_version


def _file() -> Column:
    """A row's file, as a path below the index, so that an index can be moved."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"((?:build|change)-[0-9a-f]+/points/[^/]+)$", 1)


def _manifest_of(points: DataFrame, cell: Column) -> DataFrame:
    """``(file, low, high, n, ...)``: what stands in each file, with the counts and bounds that the index sums up."""
    numbers = [F.count("*").alias("n"), F.max("dp_closest").alias("far"), *quadrant_sums()]
    box = [pick(axis).alias(f"{pick.__name__}_{axis}") for axis in ("x", "y") for pick in (F.min, F.max)]
    return points.groupBy(_file().alias("file")).agg(F.min(cell).alias("low"), F.max(cell).alias("high"), *numbers, *box)


def _owners(changes: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file`` for the cell of each new place: the last file that begins at or before it, or the first of all.

    An as-of match over range partitions; of each partition the last file goes on to those after it.
    """
    starts = manifest.select(F.col("low").alias("at"), F.lit(0).alias("asks"), "file")
    asked = changes.filter("cell IS NOT NULL").select(F.col("cell").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("string").alias("file"))
    rows = starts.unionByName(asked.distinct()).repartitionByRange("at", "asks", "file").withColumn("part", F.spark_partition_id())
    rows = written(rows, "owners")
    upto = Window.partitionBy("part").orderBy("at", "asks", "file").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("met", F.last("file", ignorenulls=True).over(upto))
    last = rows.filter("asks = 0").groupBy("part").agg(F.max_by("file", F.struct("at", "file")).alias("last"))
    parts = rows.select("part").distinct().join(last, "part", "left")
    before = F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("part", before.alias("before"))
    first = starts.agg(F.min_by("file", F.struct("at", "file")).alias("first"))
    found = met.filter("asks = 1").join(carried, "part").select(F.coalesce("met", "before").alias("file"))
    return found.filter("file IS NOT NULL").unionByName(found.filter("file IS NULL").limit(1).join(first).select(F.col("first").alias("file"))).distinct()


def _newest(changes: DataFrame, box: list[float]) -> DataFrame:
    """One row ``(uid, x, y, cell)`` per identifier, without place and cell where the point goes. With a column ``ts`` the
    newest row wins, of equally new ones the greatest place."""
    version = F.col("ts") if "ts" in changes.columns else F.lit(0)
    place = F.struct(*(F.when(usable(), F.col(axis)).alias(axis) for axis in ("x", "y")))
    newest = changes.filter("uid IS NOT NULL").groupBy("uid").agg(F.max_by(place, F.struct(version, "x", "y")).alias("place"))
    placed = newest.select("uid", "place.x", "place.y")
    return placed.withColumn("cell", F.when(F.col("x").isNotNull(), cell_in(*box)))


def update_index(spark: SparkSession, path: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, rows_per_file: int = ROWS_PER_FILE) -> LandmarkIndex:
    """Add, move and remove points: ``upserts`` has ``uid, x, y`` (and ``ts``), ``deletes`` has ``uid``.

    A point whose new coordinates are not finite numbers goes, as a build would leave it out. What is in both stays.
    Identifiers that the index does not hold are added, or ignored when they should go.
    """
    version, content = read_version(spark, path)
    stored = stored_files(spark, path, content)
    if content["order_by"] not in ("uid", "x", "y"):
        stored = stored.drop(content["order_by"])
    kind = dict(stored.dtypes)["uid"]
    parts = []
    if upserts is not None:
        newest = _newest(upserts.withColumn("uid", F.col("uid").cast(kind)), content["box"])
        parts.append(newest)
    if deletes is not None:
        gone = deletes.select(F.col("uid").cast(kind).alias("uid")).distinct()
        gone = gone.join(newest, "uid", "left_anti") if parts else gone
        parts.append(gone.selectExpr("uid", "CAST(NULL AS DOUBLE) AS x", "CAST(NULL AS DOUBLE) AS y", "CAST(NULL AS BIGINT) AS cell"))
    if not parts:
        return opened_index(spark, path, content)
    changes = written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "changes")

    cell = cell_in(*content["box"])
    if content["manifest"] is None:
        manifest = written(_manifest_of(stored, cell), "manifest")
    else:
        manifest = spark.read.parquet(f"{path}/{content['manifest']}")
    holding = stored.select("uid", _file().alias("file")).join(changes.select("uid"), "uid", "left_semi").select("file").distinct()
    touched = written(holding.unionByName(_owners(changes, manifest)).distinct(), "touched")
    old = manifest.join(touched, "file", "left_semi")
    kept = manifest.join(touched, "file", "left_anti")
    files = [row["file"] for row in old.select("file").collect()]

    pivots, extent = [Pivot(*row) for row in content["pivots"]], Extent(**content["extent"])
    folder, rows = f"change-{uuid.uuid4().hex}", changes.filter("cell IS NOT NULL").select("uid", "x", "y")
    if files:
        stayed = spark.read.parquet(*[f"{path}/{file}" for file in files]).select("uid", "x", "y")
        rows = rows.unionByName(stayed.join(changes.select("uid"), "uid", "left_anti"))
    rows = written(rows.withColumn("_cell", cell), "changed-rows")
    stored_points(rows, pivots, extent.centre, content["build"], math.ceil(rows.count() / rows_per_file)).write.parquet(f"{path}/{folder}/points")
    fresh = _manifest_of(spark.read.parquet(f"{path}/{folder}/points"), cell)
    kept.unionByName(fresh.select(*kept.columns)).write.parquet(f"{path}/{folder}/manifest")
    return _published(spark, path, version, content, folder, extent, len(files))


def _published(spark: SparkSession, path: str, version: int, content: dict, folder: str, extent: Extent, rewritten: int) -> LandmarkIndex:
    """Sum up the new manifest and make it the next version."""
    manifest = spark.read.parquet(f"{path}/{folder}/manifest")
    counts = [F.sum(f"`{sums}`").alias(sums) for sums in ("n", *content["quadrants"])]
    box = [pick(f"{pick.__name__}_{axis}").alias(f"{pick.__name__}_{axis}") for axis in ("x", "y") for pick in (F.min, F.max)]
    total = manifest.agg(*counts, *box, F.max("far").alias("far"), F.count("*").alias("files")).first().asDict()
    if not total["n"]:
        raise ValueError("the change would leave no points")
    bounds = {name: total[name] for name in ("min_x", "max_x", "min_y", "max_y")}
    extent = replace(extent, n=total["n"], **bounds)
    spacing = content["alpha"] * extent.diameter
    content = content | {
        "points": None,
        "manifest": f"{folder}/manifest",
        "extent": extent.__dict__,
        "quadrants": plain_quadrants(total, extent),
        "covered": total["far"] < spacing or total["far"] == 0.0,
        "rewritten": rewritten,
        "files": total["files"],
    }
    publish_version(spark, path, version, content)
    return opened_index(spark, path, content)


def clean_index(spark: SparkSession, path: str) -> list[str]:
    """Delete folders that the last version does not need, and say which. Nobody may be reading an older one."""
    _, content = read_version(spark, path)
    needed = {(content["points"] or "").split("/")[0]}
    if content["manifest"] is not None:
        needed.add(content["manifest"].split("/")[0])
        needed |= {row["file"].split("/")[0] for row in spark.read.parquet(f"{path}/{content['manifest']}").select("file").collect()}
    root, files = stored_path(spark, path)
    old = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith(("build-", "change-"))]
    gone = [folder for folder in old if folder.getName() not in needed]
    for folder in gone:
        files.delete(folder, True)
    return sorted(folder.getName() for folder in gone)
