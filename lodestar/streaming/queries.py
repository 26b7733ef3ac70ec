"""Range search and nearest neighbours over a stream of points."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.codec import decode_point, readable_point
from lodestar.functions.geometry import Location, distance_to, plain_distance, usable
from lodestar.operators.knn import nearest_rows
from lodestar.operators.pivots import Pivot, nearest
from lodestar.operators.search import EXCLUDE_COORDS, SLACK, box_bound, refine, without_query
from lodestar.session import local_frame
from lodestar.streaming.state import BatchState

NEIGHBOUR_SCHEMA = "uid {uid}, x double, y double, dist double"


def stream_decode(messages: DataFrame, skip_unreadable: bool = False) -> DataFrame:
    """Points ``(uid, x, y, distances)`` out of JSON messages. A broken message stops the query, unless it is to be
    skipped; ``unreadable`` gives those that are, to be stored elsewhere."""
    messages = messages.filter(readable_point("value")) if skip_unreadable else messages
    return messages.select(decode_point("value").alias("p")).select(
        F.col("p.UID").alias("uid"), "p.x", "p.y", F.col("p.distancesToPivot").alias("distances")
    )


def unreadable(messages: DataFrame) -> DataFrame:
    """Messages that are no point with both coordinates."""
    return messages.filter(~F.coalesce(readable_point("value"), F.lit(False)))


def point_pivot_distance(pivot_id: str | Column, distances: str = "distances") -> Column:
    """The stored distance to one pivot. A point that carries none stops the job instead of counting as 0."""
    key = F.lit(pivot_id) if isinstance(pivot_id, str) else pivot_id
    missing = F.raise_error(F.concat(F.lit("point without stored distance to "), key)).cast("double")
    return F.coalesce(F.try_element_at(F.col(distances), key), missing)


def stream_prune(points: DataFrame, pivots: list[Pivot], q: Location, r: float) -> DataFrame:
    """Points that their stored pivot distances do not rule out."""
    for p in pivots:
        dq = plain_distance(p.place, q)
        wide = r + SLACK * (1 + r + dq)
        points = points.filter(point_pivot_distance(p.pivot_id).between(dq - wide, dq + wide))
    return points


def stream_certain_hits(points: DataFrame, pivots: list[Pivot], q: Location, r: float) -> DataFrame:
    """Points that are surely within r by their closest pivot and its stored distance."""
    to_query = F.array(*(F.lit(plain_distance(p.place, q)) for p in pivots))
    names = F.array(*(F.lit(p.pivot_id) for p in pivots))
    at = nearest(pivots)["ord"] + 1
    return points.filter(F.lit(float(r)) >= F.element_at(to_query, at) + point_pivot_distance(F.element_at(names, at)))


def stream_range(points: DataFrame, q: Location, r: float, exclude: str = EXCLUDE_COORDS) -> DataFrame:
    """Neighbours within r: a stateless filter, one narrow stage per batch."""
    return without_query(refine(points.filter(box_bound(q, r)), q, r), q, exclude)


def stream_match_count(found: DataFrame, query_id: str) -> DataFrame:
    """Running number of matches. Each task sends one row per query to the aggregate."""
    return found.groupBy(F.lit(query_id).alias("query_id")).agg(F.count("*").alias("matches"))


WINDOW_SCHEMA = "start timestamp, matches bigint"


def stream_window_hits(points: DataFrame, q: Location, r: float, width: str, delay: str, path: str, exclude: str = EXCLUDE_COORDS, **trigger) -> StreamingQuery:
    """Neighbours within r per window of event time ``ts``. Read the counts with ``window_result``.

    Every batch adds to the windows it touches; Spark keeps a sum per open window. A window is closed when the watermark, the
    latest time seen less ``delay``, has passed its end: rows for it that come later are dropped, and counted by
    ``late_rows``. Rows without a time count nowhere.
    """
    state = BatchState(points.sparkSession, f"{path}/windows", WINDOW_SCHEMA)
    near = without_query(refine(points.filter(box_bound(q, r) & F.col("ts").isNotNull()), q, r), q, exclude)
    counts = near.withWatermark("ts", delay).groupBy(F.window("ts", width)).agg(F.count("*").alias("matches"))
    counts = counts.select("window.start", "matches")

    def merge(batch: DataFrame, batch_id: int) -> None:
        # Counts of a window only grow, so the greatest is the last one, also when a batch is run again.
        merged = state.before(batch_id).unionByName(batch).groupBy("start").agg(F.max("matches").alias("matches"))
        state.save(merged, batch_id)

    writer = counts.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def window_result(spark: SparkSession, path: str) -> DataFrame:
    """``(start, matches)`` after the last finished batch."""
    return BatchState(spark, f"{path}/windows", WINDOW_SCHEMA).latest()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window was closed, as far as the query's recent batches say."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def observed(points: DataFrame, q: Location, r: float, exclude: str = EXCLUDE_COORDS) -> DataFrame:
    """``stream_range`` that counts, inside the query, the points it takes in and the neighbours it finds."""
    taken = points.observe("points", F.count("*").alias("n"))
    return stream_range(taken, q, r, exclude).observe("matches", F.count("*").alias("n"))


def batch_metrics(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """``(batch, points, matches)`` of the recent batches of an observed query that had points."""
    found = []
    for progress in query.recentProgress:
        counts = progress["observedMetrics"]
        if counts and counts["points"]["n"]:
            found.append((progress["batchId"], counts["points"]["n"], counts["matches"]["n"]))
    return found


def nth_match(metrics: list[tuple[int, int, int]], n: int) -> int | None:
    """The batch that brought the n-th match."""
    total = 0
    for batch, _, matches in metrics:
        total += matches
        if total >= n:
            return batch
    return None


@dataclass
class StopReport:
    """When the n-th match arrived, or how many came in all if it did not."""

    reached: bool = False
    matches: int = 0
    batch_id: int | None = None
    query: StreamingQuery | None = field(default=None, repr=False)


def stream_stop_at_n(found: DataFrame, n: int, path: str, timeout: float | None = None, **trigger) -> StopReport:
    """Run until n matches have arrived, then stop the query. ``path`` holds checkpoint and running total."""
    state = BatchState(found.sparkSession, f"{path}/total", "matches bigint")
    report, done = StopReport(), threading.Event()

    def count_batch(batch: DataFrame, batch_id: int) -> None:
        before = state.before(batch_id).agg(F.sum("matches")).first()[0] or 0
        total = before + batch.count()
        state.save(local_frame(found.sparkSession, [(total,)], "matches bigint"), batch_id)
        if not report.reached:
            report.matches, report.batch_id, report.reached = total, batch_id, total >= n
        if report.reached:
            done.set()

    writer = found.writeStream.foreachBatch(count_batch).option("checkpointLocation", f"{path}/checkpoint")
    report.query = query = writer.trigger(**(trigger or {"availableNow": True})).start()
    waited = 0.0
    while query.isActive and not done.wait(0.1):
        waited += 0.1
        if timeout is not None and waited >= timeout:
            break
    if done.is_set() or query.isActive:
        query.stop()
    if query.exception():
        raise query.exception()
    return report


def stream_knn(
    points: DataFrame, q: Location, k: int, path: str, exclude: str = EXCLUDE_COORDS, **trigger
) -> StreamingQuery:
    """The k nearest points seen so far.

    Every batch is cut by the k-th distance so far, reduced to its own k nearest, and merged with the k rows
    kept. No row of the stream is shuffled to a single keyed state. Read the result with ``knn_result``.
    """
    uid_type = dict(points.dtypes)["uid"]
    state = BatchState(points.sparkSession, f"{path}/nearest", NEIGHBOUR_SCHEMA.format(uid=uid_type))

    def merge(batch: DataFrame, batch_id: int) -> None:
        best = state.before(batch_id)
        near = without_query(batch.filter(usable()).withColumn("dist", distance_to(q)), q, exclude)
        kept = best.agg(F.count("*").alias("n"), F.max("dist").alias("far")).first()
        if kept["n"] >= k:
            near = near.filter(F.col("dist") <= F.lit(kept["far"]))
        merged = near.select("uid", "x", "y", "dist").unionByName(best).persist()
        state.save(nearest_rows(merged, k), batch_id)
        merged.unpersist()

    writer = points.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def knn_result(points: DataFrame, path: str) -> DataFrame:
    """Neighbours after the last finished batch, nearest first."""
    schema = NEIGHBOUR_SCHEMA.format(uid=dict(points.dtypes)["uid"])
    return BatchState(points.sparkSession, f"{path}/nearest", schema).latest().orderBy("dist", "uid")


def stream_timing(query: StreamingQuery) -> dict[str, float]:
    """Rows, batches and milliseconds that the finished batches took."""
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    rows = sum(p["numInputRows"] for p in progress)
    millis = sum(p["durationMs"].get("triggerExecution", 0) for p in progress)
    return {"rows": rows, "batches": len(progress), "millis": millis}
