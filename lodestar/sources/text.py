"""Point files: space-delimited ``id a b`` lines and tab-separated records; WKT output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import DELIMITED_X, DELIMITED_Y, TSV_X, TSV_Y
from lodestar.functions.codec import point_wkt
from lodestar.functions.keys import point_uid
from lodestar.operators.ordering import running_offsets
from lodestar.session import written

TSV_SUFFIX = ".tsv"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(value, line)`` numbered from 0 through all files, in order of file name.

    The lines are read once and written with their split and their place in it. Counts per split, taken from what was
    written, give each split's offset, so both sides always speak of the same splits. A line whose split has no
    offset stops the job.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    lines = written(lines, "lines")
    split = ["_file", "_start"]
    sizes = lines.groupBy(*split).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    offsets = running_offsets(sizes, split, name="_before").withColumnRenamed("_file", "_f").withColumnRenamed("_start", "_s")
    same = (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s"))
    number = F.col("_before") + F.col("_at") - F.col("_first")
    missing = F.raise_error(F.concat(F.lit("lines without a number in "), F.col("_file"))).cast("long")
    return lines.join(offsets, same, "left").select("value", F.coalesce(number, missing).alias("line"))


def _positions(lines: DataFrame, separator: str, x_pos: int, y_pos: int) -> DataFrame:
    """x and y by field position. A short line or a field that is no number stops the job."""
    fields = F.split(F.col("value"), separator)
    return lines.withColumns({"x": fields[x_pos].cast("double"), "y": fields[y_pos].cast("double")})


def quarantine_lines(lines: DataFrame, separator: str, x_pos: int, y_pos: int) -> tuple[DataFrame, DataFrame]:
    """Readable points, and the lines that are not, instead of stopping at the first bad one."""
    fields = F.split(F.col("value"), separator)
    parsed = lines.withColumns(
        {"x": F.get(fields, x_pos).try_cast("double"), "y": F.get(fields, y_pos).try_cast("double")}
    )
    good = F.col("x").isNotNull() & F.col("y").isNotNull()
    return parsed.filter(good).drop("value"), parsed.filter(~good).select(*lines.columns)


def _loaded(lines: DataFrame, separator: str, x_pos: int, y_pos: int, uid, quarantine: str | None) -> DataFrame:
    """Points out of lines. With ``quarantine``, lines that cannot be read are stored in that folder instead of
    stopping the job."""
    if quarantine is None:
        return _positions(lines, separator, x_pos, y_pos).select(uid.alias("uid"), "x", "y")
    lines = written(lines.withColumn("uid", uid), "lines")
    good, bad = quarantine_lines(lines, separator, x_pos, y_pos)
    bad.write.mode("overwrite").parquet(quarantine)
    return good.select("uid", "x", "y")


def load_points_delimited(
    spark: SparkSession,
    path: str,
    x_pos: int = DELIMITED_X,
    y_pos: int = DELIMITED_Y,
    numbered: bool = False,
    quarantine: str | None = None,
) -> DataFrame:
    """``id a b`` lines, one space apart. uid is ``point_<id>``, or ``point_<line number>`` when ``numbered``."""
    if numbered:
        lines = read_lines(spark, path)
        number = F.col("line")
    else:
        lines = spark.read.text(path)
        number = F.split("value", " ")[0]
    return _loaded(lines, " ", x_pos, y_pos, point_uid(number), quarantine)


def load_points_tsv(
    spark: SparkSession, path: str, x_pos: int = TSV_X, y_pos: int = TSV_Y, quarantine: str | None = None
) -> DataFrame:
    """Tab-separated records; uid is ``point_<line number>``."""
    return _loaded(read_lines(spark, path), "\t", x_pos, y_pos, point_uid(F.col("line")), quarantine)


def load_points(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: ``.tsv`` is tab-separated, anything else is space-delimited. uid is ``point_<line number>``."""
    if path.rstrip("/").endswith(TSV_SUFFIX):
        return load_points_tsv(spark, path, **options)
    return load_points_delimited(spark, path, numbered=True, **options)


def write_wkt(points: DataFrame, path: str, decimals: int | None = None) -> None:
    """One ``"Point (x y)"`` line per point."""
    points.select(point_wkt(decimals=decimals).alias("value")).write.mode("overwrite").text(path)
