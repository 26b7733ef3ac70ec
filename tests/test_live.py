"""Live queries on a stream, and hits per window, against what batch says."""

import datetime as dt
import math
import random
from types import SimpleNamespace

import pandas as pd

from lodestar.functions.geometry import Location
from lodestar.streaming import live
from lodestar.streaming import queries as streams

START = dt.datetime(2024, 1, 1)
POINTS = "uid bigint, ts timestamp, x double, y double"
QUERIES = "query_id bigint, ts timestamp, until timestamp, x double, y double, r double, k int"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def sources(spark, path):
    spark.createDataFrame([], POINTS).write.mode("append").parquet(f"{path}/points")
    spark.createDataFrame([], QUERIES).write.mode("append").parquet(f"{path}/queries")
    return (spark.readStream.schema(s).parquet(f"{path}/{n}") for s, n in ((POINTS, "points"), (QUERIES, "queries")))


def arrive(spark, path, points=(), queries=()):
    for rows, schema, name in ((points, POINTS, "points"), (queries, QUERIES, "queries")):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/{name}")


def brute(points, queries):
    out = []
    for q, since, until, qx, qy, r, k in queries:
        near = []
        for uid, ts, x, y in points:
            d = math.sqrt((x - qx) ** 2 + (y - qy) ** 2)
            if since <= ts < until and d <= r and (x, y) != (qx, qy):
                near.append((d, uid))
        out += [(q, uid, d, n) for n, (d, uid) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def test_live_queries_equal_batch_after_a_restart(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path)
    make = lambda uid, low, high: (uid, at(rng.uniform(low, high)), rng.choice([1.0, rng.uniform(0, 30)]), rng.choice([2.0, rng.uniform(0, 30)]))
    first = [make(i, 0, 60) for i in range(300)]
    second = [make(1000 + i, 60, 120) for i in range(300)]
    early = [(i, at(0), at(rng.choice([30, 50, 90, 110])), rng.uniform(0, 30), rng.uniform(0, 30), rng.choice([2.0, 6.0, 50.0]), rng.choice([1, 5, 400])) for i in range(8)]
    early.append((8, at(0), at(100), 1.0, 2.0, 4.0, 10))
    late = [(20, at(61), at(100), 15.0, 15.0, 9.0, 7), (21, at(70), at(115), 1.0, 2.0, 0.0, 7)]
    points, queries = sources(spark, path)

    def run():
        live.stream_live_knn(points, queries, 7.0, "70 minutes", f"{path}/query", salts=3).awaitTermination()
        return live.live_result(spark, f"{path}/query")

    arrive(spark, path, first, early)
    run()
    arrive(spark, path, second, late)  # the query has ended in between; its state is in the checkpoint
    run()
    arrive(spark, path, [(9_999, at(1000), 0.0, 0.0)])  # time goes on, and all queries expire
    run()
    arrive(spark, path, [(10_000, at(2000), 0.0, 0.0), (10_001, at(5), 1.0, 2.5)])  # the last one is too late
    got = run().collect()
    want = brute(first + second, early + late)
    assert sorted((r["query_id"], r["uid"], r["dist"], r["rank"]) for r in got) == want and len(want) > 400


def test_cells_and_odd_rows(spark):
    points = spark.createDataFrame([(1, at(0), -0.5, 3.0), (2, None, 1.0, 1.0), (3, at(0), None, 1.0), (None, at(0), 1.0, 1.0), (4, at(0), float("nan"), 1.0)], POINTS)
    queries = spark.createDataFrame([(7, at(0), at(1), 0.0, 0.0, 1.0, 3), (8, at(1), at(1), 0.0, 0.0, 1.0, 3), (9, at(0), at(1), 0.0, 0.0, -1.0, 3), (10, at(0), at(1), 0.0, 0.0, 1.0, 0)], QUERIES)
    rows = live.live_rows(points, queries, 2.0, salts=2).collect()
    assert [(r["uid"], r["cx"], r["cy"]) for r in rows if not r["is_query"]] == [(1, -1, 1)]
    assert sorted((r["uid"], r["cx"], r["cy"], r["salt"]) for r in rows if r["is_query"]) == [(7, x, y, s) for x in (-1, 0) for y in (-1, 0) for s in (0, 1)]


def test_hits_per_window_with_late_rows(spark, tmp_path):
    path, q = str(tmp_path), Location(0.0, 0.0)
    points, _ = sources(spark, path)

    def run():
        query = streams.stream_window_hits(points, q, 5.0, "10 minutes", "20 minutes", f"{path}/query")
        query.awaitTermination()
        return streams.late_rows(query), {r["start"]: r["matches"] for r in streams.window_result(spark, f"{path}/query").collect()}

    arrive(spark, path, [(1, at(1), 1.0, 1.0), (2, at(2), 3.0, 4.0), (3, at(3), 9.0, 9.0), (4, at(12), 0.0, 0.0), (5, at(13), 0.0, 1.0), (6, None, 1.0, 1.0)])
    assert run() == (0, {at(0): 2, at(10): 1})
    # The first window is open until a time of 30 minutes has been seen.
    arrive(spark, path, [(7, at(9), 1.0, 0.0), (8, at(29), 1.0, 0.0)])
    assert run() == (0, {at(0): 3, at(10): 1, at(20): 1})
    arrive(spark, path, [(9, at(55), 1.0, 0.0)])
    assert run()[1] == {at(0): 3, at(10): 1, at(20): 1, at(50): 1}
    arrive(spark, path, [(10, at(8), 1.0, 0.0), (11, at(19), 1.0, 0.0), (12, at(36), 1.0, 0.0)])
    assert run() == (2, {at(0): 3, at(10): 1, at(20): 1, at(30): 1, at(50): 1})


def test_metrics_of_batches(spark, tmp_path):
    path, q = str(tmp_path), Location(0.0, 0.0)
    points, _ = sources(spark, path)
    found = []
    for part in ([(1, at(1), 1.0, 1.0), (2, at(1), 9.0, 9.0)], [(3, at(1), 8.0, 9.0)], [(4, at(1), 1.0, 2.0), (5, at(1), 2.0, 2.0)]):
        arrive(spark, path, part)
        query = streams.observed(points, q, 5.0).writeStream.format("noop").option("checkpointLocation", f"{path}/query")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        found += streams.batch_metrics(query)
    assert [(p, m) for _, p, m in found] == [(2, 1), (1, 0), (2, 2)]
    batches = [b for b, _, _ in found]
    assert [streams.nth_match(found, n) for n in (1, 2, 3, 4)] == [batches[0], batches[2], batches[2], None]


def test_broken_messages_can_be_skipped(spark):
    rows = [('{"x":1.0,"y":2.0,"UID":"a"}',), ("{broken",), ('{"x":1.0}',), (None,)]
    messages = spark.createDataFrame(rows, "value string")
    assert [(r["uid"], r["x"], r["y"]) for r in streams.stream_decode(messages, skip_unreadable=True).collect()] == [("a", 1.0, 2.0)]
    assert [r["value"] for r in streams.unreadable(messages).collect()] == [rows[1][0], rows[2][0], None]


class Held:
    """State in memory, and how often a timer was set."""

    def __init__(self):
        self.maps, self.timers = {}, []

    def getValueState(self, name, *_):  # noqa: N802
        held = self.maps
        return SimpleNamespace(update=lambda value: held.update({name: value}), clear=lambda: held.pop(name, None), exists=lambda: name in held, get=lambda: held.get(name))

    def registerTimer(self, at_ms):  # noqa: N802
        self.timers.append(at_ms)


def test_a_block_of_cells_has_one_timer():
    """Many queries with ends of their own in one state: a timer for the first, which hands out all that have ended."""
    held, worker = Held(), live.Nearest()
    worker.init(held)
    columns = ["is_query", "uid", "ts", "micros", "x", "y", "r", "k", "until", "cx", "cy", "salt"]
    asked = [(True, i, None, 0, 1.0, 1.0, 9.0, 3, 1_000_000 * (i + 1), c, 0, 0) for i in range(40) for c in (0, 1)]
    seen = [(False, 100 + i, None, 5, 1.0 + i, 1.0, 0.0, 0, 0, i // 8, 0, 0) for i in range(12)]
    key, at_ms = (0, 0, 0), lambda ms: (SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), SimpleNamespace(getExpiryTimeInMs=lambda: held.timers[-1]))
    list(worker.handleInputRows(key, iter([pd.DataFrame(seen[:5] + asked, columns=columns), pd.DataFrame(seen[5:], columns=columns)]), None))
    assert held.timers == [1000]
    first = pd.concat(worker.handleExpiredTimer(key, *at_ms(30_500)))
    assert sorted(set(first["query_id"])) == [*range(30)] and held.timers == [1000, 31_000]
    near = first[first["query_id"] == 7].sort_values(["dist", "uid"])
    assert near["uid"].tolist() == [101, 102, 103, 108, 109] and near["dist"].tolist() == [1.0, 2.0, 3.0, 8.0, 9.0]
    rest = pd.concat(worker.handleExpiredTimer(key, *at_ms(10**9)))
    assert sorted(set(rest["query_id"])) == [*range(30, 40)] and len(held.timers) == 2 and not held.maps
