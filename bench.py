"""Headline queries, timed. Prints one JSON line.

Every number is the median of three warm runs; index, search and streams all read ``$BENCH_SF_DIR``.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark import __version__
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar import build_index
from lodestar.functions.geometry import Location
from lodestar.operators import hull, pivots, search
from lodestar.operators.knn import knn
from lodestar.plans.registry import Inputs
from lodestar.session import scratch_path
from lodestar.sources import generators, text
from lodestar.streaming import queries as streams

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lodestar-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lodestar-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Sizes at which the reference's own programs run: generated points, and numbers of neighbours.
LARGE_POINTS = (750_000, 1_238_920)
LARGE_NEIGHBOURS = (37_500, 275_000)
LARGE_FILES = 8


def large(spark: SparkSession, rows) -> dict[str, dict]:
    """Generated points in several files: seconds, result rows, and how much of the index the pruned search reads."""
    found: dict[str, dict] = {}
    for n in LARGE_POINTS:
        path = scratch_path(spark, "bench-geo")
        generators.gen_geo(spark, f"{path}/text", n, 7)
        points = text.load_points_delimited(spark, f"{path}/text", x_pos=1, y_pos=2)
        points.write.parquet(f"{path}/points")
        points = spark.read.parquet(f"{path}/points")
        start = time.perf_counter()
        index = build_index(points, f"{path}/index", partitions=LARGE_FILES)
        seconds = {"build_index": time.perf_counter() - start}
        q = Location(-95.0, 37.5)
        box = index.range_query(q, 2.5)
        runs = {
            "range_r2.5": box,
            "range_r2.5_pivot_bounds": index.range_query(q, 2.5, pivot_bounds=True),
            "range_r2.5_scan": search.range_query(points, [], q, 2.5),
        }
        for k in LARGE_NEIGHBOURS:
            runs[f"knn_k{k}"] = lambda k=k: index.knn(q, k)
            runs[f"knn_scan_k{k}"] = lambda k=k: knn(points, q, k)
        for name, run in runs.items():
            for _ in range(2):
                start = time.perf_counter()
                rows(run() if callable(run) else run)
                seconds[name] = time.perf_counter() - start
        near = F.sqrt((F.col("x") - q.x) ** 2 + (F.col("y") - q.y) ** 2) <= 2.5
        touched = index.points.filter(near).select(F.input_file_name().alias("f")).distinct().count()
        found[str(n)] = {name: round(value, 3) for name, value in seconds.items()} | {
            "range_rows": box.count(),
            "files": len(index.points.inputFiles()),
            "files_with_hits": touched,
        }
    return found


def main() -> None:
    spark = session()
    given = Inputs(spark, FOLDER)
    points, q, index = given.points, given.q, given.index
    edges = given.edges
    counts: dict[str, int] = {}

    def rows(frame):
        """All columns of all rows are computed, none is moved to the driver."""
        frame.write.format("noop").mode("overwrite").save()

    def stream_range():
        path = scratch_path(spark, "bench-stream")
        found = streams.stream_range(given.stream, q, 25.0)
        writer = found.writeStream.format("noop").option("checkpointLocation", path)
        writer.trigger(availableNow=True).start().awaitTermination()

    def stream_knn():
        streams.stream_knn(given.stream, q, 10, scratch_path(spark, "bench-knn")).awaitTermination()

    runs = {
        "build_index": lambda: build_index(points, scratch_path(spark, "bench-index")),
        "convex_hull": lambda: rows(hull.convex_hull(points)),
        "diameter": lambda: rows(hull.hull_diameter(edges)),
        "sss_pivots": lambda: pivots.sss_pivots(points, index.extent.diameter),
        "pivot_distances": lambda: rows(pivots.pivot_distances(points, index.pivots)),
        "closest_pivot": lambda: rows(pivots.closest_pivot(points, index.pivots)),
        "certain_hits_r250": lambda: rows(index.certain_hits(q, 250.0)),
        "knn_k10": lambda: rows(index.knn(q, 10)),
        "knn_k1000": lambda: rows(index.knn(q, 1000)),
        "knn_scan_k10": lambda: rows(knn(points, q, 10)),
        "knn_scan_k1000": lambda: rows(knn(points, q, 1000)),
        "stream_range": stream_range,
        "stream_knn": stream_knn,
    }
    for r in (5.0, 25.0, 100.0):
        pruned, plain = index.range_query(q, r, pivot_bounds=True), search.range_query(points, [], q, r)
        runs[f"range_query_r{r:.0f}"] = lambda pruned=pruned: rows(pruned)
        runs[f"range_query_noprune_r{r:.0f}"] = lambda plain=plain: rows(plain)
        counts[f"range_query_r{r:.0f}"] = pruned.count()

    cold, seconds = {}, {}
    for name, run in runs.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        cold[name], seconds[name] = round(times[0], 4), round(statistics.median(times[1:]), 4)

    n = points.agg(F.count("*")).first()[0]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cold": cold,
                "points": n,
                "result_rows": counts,
                "prune_ratio": {
                    f"r{r}": round(seconds[f"range_query_r{r}"] / seconds[f"range_query_noprune_r{r}"], 3)
                    for r in (5, 25, 100)
                },
                "stream_rows_per_sec": round(n / seconds["stream_range"]),
                "cpus": CPUS,
                "spark": __version__,
                "runs": f"median of {RUNS} warm",
                "large": large(spark, rows),
            }
        )
    )


if __name__ == "__main__":
    main()
