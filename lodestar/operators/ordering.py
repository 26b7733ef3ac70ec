"""Sorts, first rows, exact global positions and distinct rows, none of which funnels a table into one task."""

from __future__ import annotations

from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import written
from lodestar.sources.generators import fraction

# One task may merge this many rows.
MERGE_ROWS = 1_000_000

# The low bits of monotonically_increasing_id() count rows, the others are the partition.
ROW_BITS = 33


def sort_xy(points: DataFrame) -> DataFrame:
    """By x, then y, nulls first."""
    return points.orderBy(F.col("x").asc_nulls_first(), F.col("y").asc_nulls_first())


def by_distance(found: DataFrame) -> DataFrame:
    """Ascending distance; equal distances by uid."""
    return found.orderBy("dist", "uid")


def running_offsets(sizes: DataFrame, order: list[str], size: str = "n", name: str = "before") -> DataFrame:
    """How much stands before each row of ``sizes`` in the order: the sum of ``size`` over all rows before it.

    Rows are range-partitioned; sums run inside a partition, and one sum per partition runs over the partitions.
    """
    placed = sizes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = written(placed, "sizes")
    ahead = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(*ahead)
    ranges = placed.groupBy("_range").agg(F.sum(size).alias("_sum"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(*ahead)), F.lit(0)).alias("_base"))
    summed = placed.withColumn(name, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return summed.join(ranges, "_range").withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_base")


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Position (from 0) of each row of a frame that already stands in order, partition after partition.

    The rows are written once with their place inside the partition; a count per partition gives its offset.
    """
    columns = ordered.columns
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.select(*columns, part, within.alias("_within"))
        .join(offsets, "_part")
        .select(*columns, (F.col("_before") + F.col("_within")).alias(name))
    )


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Exact position (from 0) of each row in the order, without a global window.

    ``order`` should end in a unique column: it is what splits long runs of equal keys.
    """
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def merges_directly(df: DataFrame, n: int) -> bool:
    """Whether one task may merge the first n rows of every task. The rows are the same either way.

    The number of tasks is taken from what Spark expects the plan to produce, so nothing is run to find it out.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(str(plan.stats().sizeInBytes())) // split + 1)
    return n * tasks <= MERGE_ROWS


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in the order.

    Plain ``orderBy().limit()`` sends n rows of every task to one place. Where that is too much for a task, the first
    column is bounded by counts, every task cuts its own rows to n, and what is left is ranked by a distributed sort.
    """
    if n <= 0 or merges_directly(df, n):
        return df.orderBy(*order).limit(max(n, 0))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    near = df.filter(_not_after(df, n, order[0]))
    cut = near.sortWithinPartitions(*order).withColumn("_place", place).filter(F.col("_place") < n).drop("_place")
    return ranked(cut, order, "_rank").filter(F.col("_rank") < n).drop("_rank").orderBy(*order)


def _not_after(df: DataFrame, n: int, column: str, rounds: int = 4, steps: int = 1000) -> Column:
    """A bound on the column that at least n rows meet (all rows, if there are fewer) and seldom many more.

    Counts per step between two ends narrow down where the n-th value lies: numbers by steps of equal width, text by
    its next character. At most a step's worth of rows per round comes to the driver.
    """
    value, kind = F.col(column), dict(df.dtypes)[column]
    bound = F.lit(True)
    if kind == "string":
        prefix = commonprefix([end or "" for end in df.agg(F.min(value), F.max(value)).first()])
        for _ in range(rounds):
            inside = df.filter(value.startswith(prefix)) if prefix else df
            head = F.substring(value, 1, len(prefix) + 1)
            before = df.filter(value < prefix).count() if prefix else 0
            for row in sorted(inside.groupBy(head.alias("head")).count().collect(), key=lambda r: r["head"] or ""):
                before += row["count"]
                if before >= n:
                    bound = value.isNull() | (F.substring(value, 1, len(row["head"] or "")) <= F.lit(row["head"] or ""))
                    break
            else:
                return F.lit(True)
            if before <= 2 * n or row["head"] is None or len(row["head"]) <= len(prefix):
                break
            prefix = row["head"]
        return bound
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return bound
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, high = ends["low"], ends["high"]
    for _ in range(rounds):
        if low is None or not low < high or high - low == float("inf"):
            break
        if not (width := (high - low) / steps):
            break
        step = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(steps)).alias("step")
        before = df.filter(value.isNull() | (value < F.lit(low))).count()
        counts = df.filter(value.between(F.lit(low), F.lit(high))).groupBy(step).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
        for row in sorted(counts.collect(), key=lambda r: r["step"]):
            before += row["n"]
            if before >= n:
                bound = value.isNull() | (value <= F.lit(row["most"]))
                break
        else:
            return F.lit(True)
        if before <= 2 * n:
            break
        low, high = row["least"], row["most"]
    return bound


def unique_points(points: DataFrame) -> DataFrame:
    """One row per coordinate pair, with the smallest uid at that place."""
    return points.groupBy("x", "y").agg(F.min("uid").alias("uid")).select("uid", "x", "y")


def one_per_distance(found: DataFrame) -> DataFrame:
    """One row per distance: the one with the smallest uid."""
    first = found.groupBy("dist").agg(
        F.min("uid").alias("uid"), F.min_by("x", "uid").alias("x"), F.min_by("y", "uid").alias("y")
    )
    return first.select("uid", "x", "y", "dist")


def sample_point(points: DataFrame, seed: int) -> DataFrame:
    """One point drawn at random, the same one for the same seed."""
    draw = fraction(seed, "uid", F.lit("sample"))
    return points.orderBy(draw, "uid").limit(1)
