import pytest
from pyspark.sql import functions as F

from lodestar.functions import codec
from lodestar.functions.geometry import Location
from lodestar.operators import lookup
from lodestar.sources import cells, generators, tables, text, topics
from lodestar.streaming.queries import stream_decode
from tests.fixtures import frame, scattered


def lines(tmp_path, name, content):
    path = tmp_path / name
    path.write_text("\n".join(content) + "\n")
    return str(path)


def test_delimited_and_positions(spark, tmp_path):
    path = lines(tmp_path, "nodes.txt", ["0 1.5 -2.5", "1 3 4"])
    rows = text.load_points_delimited(spark, path).orderBy("uid").collect()
    assert [tuple(row) for row in rows] == [("point_0", -2.5, 1.5), ("point_1", 4.0, 3.0)]
    rows = text.load_points_delimited(spark, path, x_pos=1, y_pos=2).orderBy("uid").collect()
    assert [tuple(row) for row in rows] == [("point_0", 1.5, -2.5), ("point_1", 3.0, 4.0)]


def test_tsv_by_suffix(spark, tmp_path):
    path = lines(tmp_path, "tweets.tsv", [f"a\tb\tc\td\te\t{i}\t{-i}" for i in range(5)])
    rows = text.load_points(spark, path).orderBy("y").collect()
    assert [tuple(row) for row in rows] == [(f"point_{i}", float(-i), float(i)) for i in range(5)]


def test_line_numbers_run_through_splits_and_files(spark, tmp_path):
    folder = tmp_path / "many.txt"
    folder.mkdir()
    number = 0
    for part in range(3):
        content = []
        for _ in range(400 * (3 - part)):
            content.append(f"{number} {number}.5 1")
            number += 1
        lines(folder, f"part-{part}.txt", content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        loaded = text.read_lines(spark, str(folder))
        assert loaded.rdd.getNumPartitions() > 10
        wrong = loaded.filter(F.split("value", " ")[0].cast("long") != F.col("line"))
        assert (loaded.count(), wrong.count()) == (number, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("bad", ["1 x 2", "1 2"])
def test_bad_line_stops_the_load(spark, tmp_path, bad):
    path = lines(tmp_path, "nodes.txt", ["0 1 2", bad])
    with pytest.raises(Exception):
        text.load_points_delimited(spark, path).collect()


def test_quarantine(spark, tmp_path):
    path = lines(tmp_path, "nodes.txt", ["0 1 2", "1 x 2", "2 2", "3 4 5"])
    good, bad = text.quarantine_lines(text.read_lines(spark, path), " ", 2, 1)
    assert sorted(tuple(row) for row in good.collect()) == [(0, 2.0, 1.0), (3, 5.0, 4.0)]
    assert sorted(row["line"] for row in bad.collect()) == [1, 2]


def test_json_round_trip_and_defaults(spark):
    points = frame(spark, [(1.25, -3e-7), (1e300, 0)])
    value = codec.encode_point(distances=F.create_map(F.lit("pivot_0"), F.col("x")))
    back = points.select("uid", "x", "y", value.alias("value")).withColumn("p", codec.decode_point())
    for row in back.collect():
        assert (row["p"]["x"], row["p"]["y"], row["p"]["UID"]) == (row["x"], row["y"], str(row["uid"]))
        assert row["p"]["distancesToPivot"] == {"pivot_0": row["x"]}
    sparse = spark.createDataFrame([('{"y":2.0,"numStormIterations":1}',)], "value string")
    decoded = sparse.select(codec.decode_point().alias("p")).select("p.x", "p.y", "p.UID")
    assert tuple(decoded.first()) == (0.0, 2.0, None)
    broken = spark.createDataFrame([("{nonsense",)], "value string")
    assert not broken.select(codec.readable_point()).first()[0]
    with pytest.raises(Exception):
        broken.select(codec.decode_point()).collect()


def test_generators_do_not_depend_on_partitioning(spark):
    one = generators.gen_uniform(spark, 2.0, 3.0, seed=5, n=500)
    assert one.exceptAll(generators.uniform_points(spark.range(500).repartition(7), 2.0, 3.0, 5)).count() == 0
    row = one.agg(F.min("x"), F.max("x"), F.count_distinct("x"), F.avg("y")).first()
    assert 2.0 <= row[0] and row[1] < 3.0 and row[2] == 500 and abs(row[3] - 2.5) < 0.05


def test_geo_file_loads(spark, tmp_path):
    path = str(tmp_path / "geo.txt")
    generators.gen_geo(spark, path, 200, seed=1)
    points = text.load_points_delimited(spark, path, x_pos=1, y_pos=2)
    assert points.count() == 200
    row = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert -125.848974 < row[0] and row[1] <= -66.885444 and row[2] >= 24.396308 and row[3] < 50.384358


def test_cells_keep_the_newest_version(spark, tmp_path):
    rows = [("a", "POINT", "POJO", 1, "old"), ("a", "POINT", "POJO", 2, "new"), ("b", "POINT", "POJO", 1, "b")]
    rows += [("hot", "POINT", "POJO", i, str(i)) for i in range(500)]
    path = str(tmp_path / "cells")
    cells.write_cells(spark.createDataFrame(rows, cells.CELL_SCHEMA), path)
    newest = cells.latest_cells(cells.open_cells(spark, path))
    assert {(row["row"], row["value"]) for row in newest.collect()} == {("a", "new"), ("b", "b"), ("hot", "499")}


def test_lookups(spark):
    rows = [(r, f, q, 1, r + f + q) for r in ("a", "ab", "b") for f in ("F", "G") for q in ("p", "q")]
    table = spark.createDataFrame(rows, cells.CELL_SCHEMA)

    def found(frame):
        return sorted(row["value"] for row in frame.collect())

    assert found(lookup.scan_column(table, "F", "p")) == ["aFp", "abFp", "bFp"]
    assert found(lookup.lookup_row(table, "a", "F", "q")) == ["aFq"]
    assert found(lookup.lookup_row_family(table, "a", "G")) == ["aGp", "aGq"]
    assert found(lookup.lookup_prefix(table, "a", "F", "p")) == ["aFp", "abFp"]
    assert found(lookup.lookup_key_range(table, ("a", "F", "q"), ("ab", "F", "p"))) == ["aFq", "aGp", "aGq", "abFp"]
    assert found(lookup.grep_key(table, "b")) == sorted(v for _, _, _, _, v in rows if not v.startswith(("aF", "aG")))
    assert found(lookup.batch_lookup(lookup.scan_column(table, "F", "p"), ["a", "b"])) == ["aFp", "bFp"]
    many = ["b"] + [f"none{i}" for i in range(1500)]
    assert found(lookup.batch_lookup(lookup.scan_column(table, "F", "p"), many)) == ["bFp"]
    assert lookup.scan_first(table, "G").first()["value"] == "aGp"


def test_term_intersect_with_many_terms(spark):
    wanted = [f"t{i}" for i in range(130)]
    rows = [(1, t) for t in wanted] + [(2, t) for t in wanted[1:]] + [(3, t) for t in wanted] + [(3, "t0")] * 5
    index = spark.createDataFrame(rows, "id long, term string")
    assert sorted(row["id"] for row in lookup.term_intersect(index, wanted).collect()) == [1, 3]
    with pytest.raises(ValueError):
        lookup.term_intersect(index, [])


def test_postings_are_distinct_words_of_the_whole_text(spark):
    texts = spark.createDataFrame([(1, "The end, the END. " + "filler " * 5000 + "last"), (2, "")], "id long, text string")
    rows = sorted(tuple(row) for row in lookup.postings(texts, "id", "text").collect())
    assert rows == [(1, "end"), (1, "filler"), (1, "last"), (1, "the")]
    some = lookup.postings(texts, "id", "text", ["last", "the", "none"])
    assert sorted(row["term"] for row in some.collect()) == ["last", "the"]


def test_upsert(spark):
    schema = "uid long, x double, y double, ts int"
    base = spark.createDataFrame([(1, 1.0, 1.0, 5), (2, 2.0, 2.0, 5), (3, 3.0, 3.0, 5)], schema)
    updates = spark.createDataFrame(
        [(1, 9.0, 9.0, 4), (2, 8.0, 8.0, 6), (2, 7.0, 7.0, 7), (4, 4.0, 4.0, 1), (4, 5.0, None, 2)], schema
    )
    rows = sorted(tuple(row) for row in tables.upserted(base, updates).collect())
    assert rows == [(1, 1.0, 1.0, 5), (2, 7.0, 7.0, 7), (3, 3.0, 3.0, 5), (4, 5.0, None, 2)]


def test_tables_are_created_and_recreated(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS source_tests LOCATION '{tmp_path}/db'")
    tables.ensure_table(spark, "source_tests.t", "uid long")
    spark.range(3).write.insertInto("source_tests.t")
    tables.ensure_table(spark, "source_tests.t", "uid long")
    assert spark.table("source_tests.t").count() == 3
    tables.recreate_table(spark, "source_tests.t", "uid long")
    assert spark.table("source_tests.t").count() == 0


def test_topic_folder_round_trip(spark, tmp_path):
    points = frame(spark, scattered(40, 3))
    topics.publish_points(points, {"path": str(tmp_path / "topic")})
    read = stream_decode(topics.stream_messages(spark, {"path": str(tmp_path / "topic")})).select("uid", "x", "y")
    query = read.writeStream.format("memory").queryName("topic_rows").trigger(availableNow=True).start()
    query.awaitTermination()
    want = points.select(F.col("uid").cast("string"), "x", "y")
    assert spark.table("topic_rows").exceptAll(want).count() == 0
    assert spark.table("topic_rows").count() == 40


def test_wkt(spark, tmp_path):
    text.write_wkt(frame(spark, [(1.5, -2)]), str(tmp_path / "wkt"))
    assert spark.read.text(str(tmp_path / "wkt")).first()[0] == '"Point (1.5 -2.0)"'
    assert Location(1, 2).y == 2
