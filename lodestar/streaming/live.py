"""Many queries on one stream of points: each has a place, a reach, a number of neighbours and a time to live.

Queries arrive on the stream like points and expire by event time. A point goes to one grid cell however many queries there
are, a query to the cells that it reaches into. A block of cells is one keyed state, so that a call to Python serves many
cells; a crowded block spreads over ``salts`` states, each of which knows the block's queries. A state holds, per cell, its
queries and the nearest points that it has seen for each. When the watermark passes the end of a query, a timer hands out
what the state has for it, and for all others that have ended, and forgets them. The final neighbours are the nearest of
what the states hand out.

Defined results: a query sees the points that reach the stream in its batch or later, with a time from its own up to, not
including, its end, within its reach and not at its place; points later than the watermark are dropped; of equally distant
points the least identifiers stay; a query that nothing reaches hands out nothing; rows without a time, a place or an
identifier take no part; a repeated query id replaces the query in the cells that it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestar.functions.geometry import usable

FOUND = "query_id bigint, k int, uid bigint, x double, y double, dist double"
KEY = ["block_x", "block_y", "salt"]
#: Bits of a block's width in cells.
BLOCK_BITS = 3
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Nearest(StatefulProcessor):
    """Live queries of a block's cells, and the nearest points so far for each query in each cell. Both are kept as columns, one
    value per block, since every access to the state is a call to another process."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        entry = "query_id array<bigint>, cx array<bigint>, cy array<bigint>"
        self.queries = handle.getValueState("queries", f"{entry}, x array<double>, y array<double>, r array<double>, k array<int>, since array<bigint>, until array<bigint>")
        self.best = handle.getValueState("best", f"{entry}, dist array<double>, uid array<bigint>, x array<double>, y array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        points, asked = [], {}
        for batch in rows:
            is_query = batch["is_query"].to_numpy(dtype=bool)
            columns = {name: batch[name].to_numpy() for name in ("uid", "cx", "cy", "x", "y", "r", "k", "micros", "until")}
            if not is_query.all():
                points.append([columns[name][~is_query] for name in ("x", "y", "uid", "micros", "cx", "cy")])
            for q, cx, cy, *query in zip(*(column[is_query].tolist() for column in columns.values()), strict=True):
                asked[q, cx, cy] = query
        live = self._live() | asked
        if asked:
            self._keep(self.queries, zip(*((*entry, *query) for entry, query in live.items()), strict=True))
            self._wake(min(query[-1] for query in asked.values()))
        if points and live:
            self._offer(live, *map(np.concatenate, zip(*points, strict=True)))
        return iter([])

    def _live(self) -> dict:
        """Queries by identifier and cell: place, reach, number of neighbours, and their time."""
        return {row[:3]: row[3:] for row in zip(*(self.queries.get() or ()), strict=True)}

    def _keep(self, state, columns) -> None:
        """Columns as the value of a state; without rows there is none."""
        columns = tuple(map(list, columns))
        if columns and columns[0]:
            state.update(columns)
        else:
            state.clear()

    def _wake(self, until: int) -> None:
        """One timer, for the query that ends first; it sees to the next one."""
        self.handle.registerTimer(-(-until // 1000))

    def _offer(self, live: dict, x, y, uid, micros, cx, cy) -> None:
        """Merge some points into what every live query has in their cells."""
        order = np.lexsort((cy, cx))
        x, y, uid, micros, cx, cy = (column[order] for column in (x, y, uid, micros, cx, cy))
        starts = np.flatnonzero(np.r_[True, (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
        ends = np.r_[starts[1:], len(x)]
        cells = {(int(cx[a]), int(cy[a])): slice(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
        found = []
        for (query, *cell), (qx, qy, r, k, since, until) in live.items():
            here = cells.get(tuple(cell))
            if here is None:
                continue
            dx, dy = x[here] - qx, y[here] - qy
            dist = np.sqrt(dx * dx + dy * dy)
            near = np.flatnonzero((dist <= r) & (micros[here] >= since) & (micros[here] < until) & ((x[here] != qx) | (y[here] != qy)))
            if len(near):
                near = near[np.lexsort((uid[here][near], dist[near]))[:k]]
                entry = [np.full(len(near), part) for part in (query, *cell)]
                found.append([*entry, dist[near], uid[here][near], x[here][near], y[here][near]])
        if not found:
            return
        best = [np.concatenate(column) for column in zip(*found, *([self.best.get()] if self.best.exists() else []), strict=True)]
        order = np.lexsort((best[4], best[3], best[2], best[1], best[0]))
        best = [column[order] for column in best]
        starts = np.flatnonzero(np.r_[True, np.any([column[1:] != column[:-1] for column in best[:3]], axis=0)])
        sizes = np.diff(np.r_[starts, len(order)])
        most = [live[entry][3] for entry in zip(*(column[starts].tolist() for column in best[:3]), strict=True)]
        first = np.arange(len(order)) - np.repeat(starts, sizes) < np.repeat(most, sizes)
        self._keep(self.best, (column[first].tolist() for column in best))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        live = self._live()
        ended = {entry: query[3] for entry, query in live.items() if query[-1] <= now}
        later = {entry: query for entry, query in live.items() if entry not in ended}
        if ended:
            self._keep(self.queries, zip(*((*entry, *query) for entry, query in later.items()), strict=True))
            best = [*zip(*(self.best.get() or ()), strict=True)]
            out = [row for row in best if row[:3] in ended]
            if out:
                self._keep(self.best, zip(*(row for row in best if row[:3] not in ended), strict=True))
                query, _, _, dist, uid, x, y = zip(*out, strict=True)
                yield pd.DataFrame({"query_id": query, "k": [ended[row[:3]] for row in out], "uid": uid, "x": x, "y": y, "dist": dist})
        if later:
            self._wake(min(query[-1] for query in later.values()))

    def close(self) -> None:
        pass


def live_rows(points: DataFrame, queries: DataFrame, side: float, salts: int = 1) -> DataFrame:
    """Points ``(uid, ts, x, y)`` and queries ``(query_id, ts, until, x, y, r, k)`` as rows of one stream, by cell.

    ``side`` is the width of a cell. It should be about as large as a query's reach: a query goes to every cell that
    its reach touches.
    """

    def cell(value) -> F.Column:
        return F.floor(value / F.lit(float(side))).cast("long")

    micros = F.unix_micros("ts")
    whole = usable() & F.col("ts").isNotNull()
    seen = points.filter(whole & F.col("uid").isNotNull()).select(
        F.lit(False).alias("is_query"), F.col("uid").cast("long").alias("uid"), "ts", micros.alias("micros"), "x", "y",
        # No nulls: whole numbers must arrive as such.
        F.lit(0.0).alias("r"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("until"),
        cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"), F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int").alias("salt"),
    )
    sound = whole & F.col("query_id").isNotNull() & (F.col("r") >= 0) & (F.col("k") > 0) & (F.col("until") > F.col("ts"))
    reach = F.col("r") * (1 + 1e-9)
    asked = queries.filter(sound).select(
        F.lit(True).alias("is_query"), F.col("query_id").cast("long").alias("uid"), "ts", micros.alias("micros"), "x", "y",
        F.col("r").cast("double").alias("r"), F.col("k").cast("int").alias("k"), F.unix_micros("until").alias("until"),
    )
    asked = asked.withColumn("cx", F.explode(F.sequence(cell(F.col("x") - reach), cell(F.col("x") + reach))))
    asked = asked.withColumn("cy", F.explode(F.sequence(cell(F.col("y") - reach), cell(F.col("y") + reach))))
    return seen.unionByName(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))


def stream_live_knn(points: DataFrame, queries: DataFrame, side: float, delay: str, path: str, salts: int = 1, **trigger) -> StreamingQuery:
    """Run the queries over the points; both are streams. ``path`` holds checkpoint and result, so the query can be stopped
    and started again. Read what has expired with ``live_result``."""
    rows = live_rows(points, queries, side, salts).withWatermark("ts", delay)
    rows = rows.withColumns({f"block_{axis}": F.shiftright(f"c{axis}", BLOCK_BITS) for axis in "xy"})
    found = rows.groupBy(*KEY).transformWithStateInPandas(Nearest(), FOUND, "Append", "EventTime")
    spark = points.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # taken over by the query when it starts
    try:
        writer = found.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start(f"{path}/found")
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def live_result(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, uid, x, y, dist, rank)`` of the queries that have expired."""
    order = Window.partitionBy("query_id").orderBy("dist", "uid")
    ranked = spark.read.schema(FOUND).parquet(f"{path}/found").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= F.col("k")).drop("k")
