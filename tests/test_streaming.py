import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions.geometry import Location
from lodestar.streaming import queries as streams
from lodestar.streaming.state import BatchState
from tests.fixtures import POINT_SCHEMA, brute_range, frame, hot_spot

Q = Location(0.5, -1.5)
PLACES = hot_spot(900, 31)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "points")
    frame(spark, PLACES).repartition(9).write.parquet(path)
    return path


def stream(spark, folder):
    """Three files to a batch."""
    return spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", 3).parquet(folder)


def test_range_stream_equals_batch(spark, folder):
    found = streams.stream_range(stream(spark, folder), Q, 20.0)
    query = found.writeStream.format("memory").queryName("ranged").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sorted((row["dist"], row["uid"]) for row in spark.table("ranged").collect())
    assert rows == brute_range(PLACES, Q, 20.0)
    timing = streams.stream_timing(query)
    assert timing["rows"] == len(PLACES) and timing["batches"] == 3 and timing["millis"] > 0


@pytest.mark.parametrize("k", [5, 350])
def test_knn_stream_equals_batch(spark, folder, tmp_path, k):
    streams.stream_knn(stream(spark, folder), Q, k, str(tmp_path)).awaitTermination()
    rows = streams.knn_result(stream(spark, folder), str(tmp_path)).collect()
    assert [(row["dist"], row["uid"]) for row in rows] == brute_range(PLACES, Q, math.inf)[:k]


def test_knn_stream_goes_on_after_a_restart(spark, tmp_path):
    source, path = str(tmp_path / "points"), str(tmp_path / "query")
    for shift, part in ((0, PLACES[:400]), (400, PLACES[400:])):
        frame(spark, part).withColumn("uid", F.col("uid") + shift).write.mode("append").parquet(source)
        streams.stream_knn(stream(spark, source), Q, 50, path).awaitTermination()
    rows = streams.knn_result(stream(spark, source), path).collect()
    assert [(row["dist"], row["uid"]) for row in rows] == brute_range(PLACES, Q, math.inf)[:50]


def test_running_count(spark, folder):
    counts = streams.stream_match_count(streams.stream_range(stream(spark, folder), Q, 20.0), "q")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete")
    query.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(row) for row in spark.table("counted").collect()] == [("q", len(brute_range(PLACES, Q, 20.0)))]


def test_stop_when_n_have_arrived(spark, folder, tmp_path):
    found = streams.stream_range(stream(spark, folder), Q, 1000.0)
    report = streams.stream_stop_at_n(found, 400, str(tmp_path / "a"))
    assert report.reached and report.matches >= 400 and report.batch_id < 2 and not report.query.isActive
    report = streams.stream_stop_at_n(found, 10_000, str(tmp_path / "b"))
    assert not report.reached and report.matches == len(brute_range(PLACES, Q, 1000.0))


def test_state_survives_a_repeated_batch(spark, tmp_path):
    state = BatchState(spark, str(tmp_path), "n bigint")
    for batch in (0, 1, 1, 2, 2):
        before = state.before(batch).agg(F.sum("n")).first()[0] or 0
        state.save(spark.createDataFrame([(before + 10,)], "n bigint"), batch)
    assert state.latest().first()["n"] == 30


def test_point_without_stored_distance_stops(spark):
    points = spark.createDataFrame([("a", {"pivot_0": 1.5})], "uid string, distances map<string,double>")
    assert points.select(streams.point_pivot_distance("pivot_0")).first()[0] == 1.5
    with pytest.raises(Exception, match="without stored distance"):
        points.select(streams.point_pivot_distance("pivot_1")).collect()
