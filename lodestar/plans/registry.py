"""Every operator as a query over the test tables.

Points are the events: ``uid = event_id``, ``x = user_id``, ``y = value``. The index over them, and the keyed
cells made from it, are built once per session and folder and then shared by the queries that read them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import PREVIEW_ROWS
from lodestar.functions import codec, geometry, keys
from lodestar.functions.geometry import Location
from lodestar.operators import group_hull, hull, joins, lookup, ordering, pivots, quadrants, search
from lodestar.operators.knn import knn
from lodestar.plans import metric, postings, upkeep
from lodestar.plans.index import LandmarkIndex, build_index
from lodestar.session import local_frame, make_folder, rename, scratch_path, written
from lodestar.sources import cells as cell_table
from lodestar.sources import generators, tables, text, topics
from lodestar.streaming import live
from lodestar.streaming import queries as streams

# The query point, radii and counts used throughout; the oracle statements use the same.
QUERY_UID = 41
RADIUS = 25.0
WIDE_RADIUS = 250.0
NEIGHBOURS = 100
ASKED_EVERY = 100
JOIN_NEIGHBOURS = 10
VECTOR_RADIUS = 1.2
VECTOR_SPACING = 1.3
LIVE_RADIUS = 8.0
LIVE_DAYS = 3
SEED = 7
STOP_AFTER = 100
STOP_FILES = 8
TERMS = ["the", "with"]
TERM_SETS = [TERMS, ["de", "la", "que"], ["und"], ["the", "nosuchterm"]]
GREP_TERMS = ["7", "_4", "t_41", "_1_", "nt_99"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Inputs:
    """Test tables, and what is derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def points(self) -> DataFrame:
        return as_points(self.events)

    @cached_property
    def q(self) -> Location:
        row = self.points.filter(F.col("uid") == QUERY_UID).first()
        return Location(row["x"], row["y"])

    @cached_property
    def index(self) -> LandmarkIndex:
        return build_index(self.points, scratch_path(self.spark, "index"))

    @cached_property
    def vector_index(self) -> metric.VectorIndex:
        return metric.build_vector_index(_vectors(self), scratch_path(self.spark, "vectors"), VECTOR_SPACING)

    @cached_property
    def edges(self) -> DataFrame:
        return hull.convex_hull(self.points)

    @cached_property
    def centre(self) -> Location:
        return self.index.extent.centre

    @cached_property
    def cells(self) -> DataFrame:
        """The whole index as keyed cells, with the marks of one range query."""
        index, early, late = self.index, F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
        named = index.points.withColumn("uid", keys.point_uid("uid"))
        marks = search.flagged(named, index.pivots, self.q, RADIUS, "q41")
        hits = search.range_query(named, index.pivots, self.q, RADIUS, ordered=False)
        parts = [
            cell_table.point_cells(named, early, pivots.distance_map(index.pivots)),
            cell_table.mark_cells(marks.filter("is_candidate"), "ISCANDIDATE", late),
            cell_table.mark_cells(hits, "WITHINRANGE", late, codec.encode_point()),
            cell_table.pivot_cells(index.pivots_frame(), 1),
            cell_table.quadrant_cells(index.quadrants_frame(), index.extent, 1),
            cell_table.count_cell(self.points, 1),
        ]
        cells = parts[0]
        for part in parts[1:]:
            cells = cells.unionByName(part)
        path = scratch_path(self.spark, "cells")
        cell_table.write_cells(cells, path)
        return cell_table.open_cells(self.spark, path)

    @cached_property
    def pivot_maps(self) -> str:
        """Folder of the long form of all distances, one folder per pivot."""
        path = scratch_path(self.spark, "pivot-maps")
        pivots.write_pivot_maps(pivots.pivot_distances(self.points, self.index.pivots), path)
        return path

    @cached_property
    def topic(self) -> str:
        """Folder that holds every point as a JSON message with its pivot distances."""
        path = scratch_path(self.spark, "topic")
        topics.publish_points(self.index.points, {"path": path}, pivots.distance_map(self.index.pivots))
        return path

    @property
    def stream(self) -> DataFrame:
        """The events as a stream of points."""
        reader = self.spark.readStream.schema(self.events.schema).option("pathGlobFilter", "events.parquet")
        return as_points(reader.parquet(self.folder))

    @property
    def timed_stream(self) -> DataFrame:
        """The same with the time of each event."""
        reader = self.spark.readStream.schema(self.events.schema).option("pathGlobFilter", "events.parquet")
        return as_timed_points(reader.parquet(self.folder))

    @property
    def messages(self) -> DataFrame:
        return streams.stream_decode(topics.stream_messages(self.spark, {"path": self.topic}))

    def drained(self, stream: DataFrame, label: str) -> DataFrame:
        """Run a stream over all that is there and read what it wrote."""
        path = scratch_path(self.spark, label)
        writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        writer.format("parquet").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
        return self.spark.read.schema(stream.schema).parquet(f"{path}/out")


def as_points(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("uid"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y")
    )


def as_timed_points(events: DataFrame) -> DataFrame:
    """Points with their time. Tables hold times without a zone, streams need one: it is the session's."""
    return events.select(F.col("event_id").alias("uid"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))


_inputs: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    return _inputs.setdefault((spark.sparkContext.applicationId, folder), Inputs(spark, folder))


def query(build: Callable[[Inputs], DataFrame] | None = None, *, name: str | None = None):
    """Register a query, under its function's name unless another one is given."""
    if build is None:
        return lambda named: query(named, name=name)
    QUERIES[name or build.__name__] = lambda spark, folder: build(inputs(spark, folder))
    return build


# Sources and sinks


@query
def load_points_delimited(given: Inputs) -> DataFrame:
    path = scratch_path(given.spark, "delimited")
    given.points.select(F.concat_ws(" ", "uid", "y", "x").alias("value")).write.text(path)
    return text.load_points_delimited(given.spark, path)


def _tsv(given: Inputs) -> str:
    path = scratch_path(given.spark, "tweets") + ".tsv"
    filler = [F.lit("-")] * 5
    line = F.concat_ws("\t", *filler, "y", "x")
    given.points.orderBy("uid").select(line.alias("value")).write.text(path)
    return path


@query
def load_points_tsv(given: Inputs) -> DataFrame:
    return text.load_points_tsv(given.spark, _tsv(given))


@query
def load_points(given: Inputs) -> DataFrame:
    path = scratch_path(given.spark, "nodes")
    given.points.orderBy("uid").select(F.concat_ws(" ", "uid", "y", "x").alias("value")).write.text(path)
    plain = text.load_points(given.spark, path).withColumn("source", F.lit("delimited"))
    return plain.unionByName(text.load_points(given.spark, _tsv(given)).withColumn("source", F.lit("tsv")))


@query
def assign_uid_seq(given: Inputs) -> DataFrame:
    numbered = ordering.ranked(given.points, ["uid"], "line")
    return numbered.select(keys.point_uid("line").alias("point_uid"), "uid")


@query
def assign_uid_hashed(given: Inputs) -> DataFrame:
    return given.points.select("uid", keys.hashed_uid(F.col("uid").cast("string")).alias("hashed"))


@query
def dataset_count(given: Inputs) -> DataFrame:
    return cell_table.dataset_count(given.cells)


@query
def encode_json(given: Inputs) -> DataFrame:
    return given.points.select("uid", codec.encode_point().alias("value"))


@query
def decode_json(given: Inputs) -> DataFrame:
    return cell_table.read_points(given.cells).select("uid", "x", "y")


@query
def write_points(given: Inputs) -> DataFrame:
    return given.index.points.select("uid", "x", "y", "closest_pivot")


@query
def upsert_points(given: Inputs) -> DataFrame:
    """Clicks move by one, older views do not win, purchases also appear under new identifiers."""
    base = as_points(given.events).withColumn("ts", F.lit(10))
    clicks = as_points(given.events.filter("event_type = 'click'")).withColumn("x", F.col("x") + 1)
    views = as_points(given.events.filter("event_type = 'view'")).withColumn("x", F.col("x") + 2)
    bought = as_points(given.events.filter("event_type = 'purchase'")).withColumn("uid", -F.col("uid") - 1)
    updates = (
        clicks.withColumn("ts", F.lit(11))
        .unionByName(clicks.withColumn("x", -F.col("x")).withColumn("ts", F.lit(10)))
        .unionByName(views.withColumn("ts", F.lit(9)))
        .unionByName(bought.withColumn("ts", F.lit(11)))
    )
    return tables.upsert_points(base, updates, scratch_path(given.spark, "upserted"))


@query
def latest_cells(given: Inputs) -> DataFrame:
    older = given.cells.withColumns({"ts": F.col("ts") - 1, "value": F.lit("{}")})
    newest = cell_table.latest_cells(given.cells.unionByName(older))
    point = F.when((F.col("cf") == "POINT") & (F.col("cq") == "POJO"), codec.decode_point("value"))
    return newest.withColumn("p", point).select("row", "cf", "cq", "ts", "p.x", "p.y")


@query
def write_pivots(given: Inputs) -> DataFrame:
    return written(given.index.pivots_frame(), "pivots")


@query
def read_pivots(given: Inputs) -> DataFrame:
    return cell_table.read_pivots(given.cells)


@query
def write_quadrants(given: Inputs) -> DataFrame:
    return _rounded(written(given.index.quadrants_frame(), "quadrants"), "area", "density")


@query
def read_quadrant(given: Inputs) -> DataFrame:
    names = list(given.index.quadrants)
    found = cell_table.read_quadrant(given.cells, names[0])
    for name in names[1:]:
        found = found.unionByName(cell_table.read_quadrant(given.cells, name))
    return _rounded(found, "area", "density")


@query
def read_centroid(given: Inputs) -> DataFrame:
    return _rounded(cell_table.read_centroid(given.cells), "x", "y")


def _in_database(given: Inputs, fill: Callable[[str, str], None]) -> DataFrame:
    """What a table holds after ``fill(name, schema)``, in a database of its own that goes again."""
    path = scratch_path(given.spark, "catalog")
    database = "lodestar_" + path.rsplit("-", 1)[1]
    given.spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    try:
        fill(f"{database}.points", "uid bigint, x double, y double")
        return written(given.spark.table(f"{database}.points"), "table")
    finally:
        given.spark.sql(f"DROP DATABASE {database} CASCADE")


@query
def ensure_table(given: Inputs) -> DataFrame:
    def fill(name: str, schema: str) -> None:
        tables.ensure_table(given.spark, name, schema)
        given.points.write.insertInto(name)
        tables.ensure_table(given.spark, name, schema)

    return _in_database(given, fill)


@query
def recreate_table(given: Inputs) -> DataFrame:
    """All points moved by one; none of the rows from before is left."""

    def fill(name: str, schema: str) -> None:
        tables.recreate_table(given.spark, name, schema)
        given.points.write.insertInto(name)
        tables.recreate_table(given.spark, name, schema)
        given.points.withColumn("x", F.col("x") + 1).write.insertInto(name)

    return _in_database(given, fill)


@query
def publish_points(given: Inputs) -> DataFrame:
    """What a consumer finds in the topic."""
    return streams.stream_decode(given.spark.read.text(given.topic)).select("uid", "x", "y")


@query
def stream_points(given: Inputs) -> DataFrame:
    return given.drained(given.messages.select("uid", "x", "y"), "streamed")


@query
def scan_count(given: Inputs) -> DataFrame:
    return lookup.scan_count(given.cells, "POINT")


@query
def scan_first(given: Inputs) -> DataFrame:
    return lookup.scan_first(given.cells, "POINT").select("row", "cf", "cq", "ts")


@query
def write_wkt(given: Inputs) -> DataFrame:
    path = scratch_path(given.spark, "wkt")
    text.write_wkt(given.points, path, decimals=2)
    return given.spark.read.text(path).withColumnRenamed("value", "line")


@query
def gen_uniform(given: Inputs) -> DataFrame:
    """As many points as there are events."""
    return generators.gen_uniform(given.spark, -5.0, 5.0, SEED, given.points.count())


@query
def gen_geo(given: Inputs) -> DataFrame:
    """A file of as many points as there are events, read back."""
    path = scratch_path(given.spark, "geo")
    generators.gen_geo(given.spark, path, given.points.count(), SEED)
    return text.load_points_delimited(given.spark, path, x_pos=1, y_pos=2)


# Filters and lookups


def _typed(cells: DataFrame) -> DataFrame:
    """Point cells with decoded coordinates in place of text."""
    return cells.withColumn("p", codec.decode_point("value")).select("row", "cf", "cq", "p.x", "p.y")


@query
def scan_column(given: Inputs) -> DataFrame:
    return _typed(lookup.scan_column(given.cells, "POINT", "POJO"))


@query
def lookup_row(given: Inputs) -> DataFrame:
    return _typed(lookup.lookup_row(given.cells, f"point_{QUERY_UID}", "POINT", "POJO"))


@query
def lookup_row_family(given: Inputs) -> DataFrame:
    return lookup.lookup_row_family(given.cells, f"point_{QUERY_UID}", "POINT").select("row", "cf", "cq", "ts")


@query
def lookup_prefix(given: Inputs) -> DataFrame:
    return _typed(lookup.lookup_prefix(given.cells, "point_4", "POINT", "POJO"))


@query
def lookup_key_range(given: Inputs) -> DataFrame:
    low, high = ("point_2", "POINT", "ISCANDIDATE"), ("point_7", "POINT", "POJO")
    return lookup.lookup_key_range(given.cells, low, high).select("row", "cf", "cq")


@query
def batch_lookup(given: Inputs) -> DataFrame:
    bought = given.events.filter("event_type = 'purchase'").select(keys.point_uid("event_id").alias("row"))
    return _typed(lookup.batch_lookup(lookup.scan_column(given.cells, "POINT", "POJO"), bought))


@query
def term_intersect(given: Inputs) -> DataFrame:
    index = lookup.postings(given.table("documents"), "doc_id", "text", TERMS)
    return lookup.term_intersect(index, TERMS).withColumnRenamed("id", "doc_id")


@query
def grep_key(given: Inputs) -> DataFrame:
    return _typed(lookup.scan_column(lookup.grep_key(given.cells, "_41"), "POINT", "POJO"))


@query
def term_postings(given: Inputs) -> DataFrame:
    """Documents that have all of some terms, out of a stored index to which a third of them was appended."""
    rows = postings.text_rows(given.table("documents"), "doc_id", "text")
    late = F.pmod("id", F.lit(3)) == 0
    path = scratch_path(given.spark, "postings")
    postings.build_postings(rows.filter(~late), path).append(rows.filter(late))
    found = postings.rows_with_all(postings.open_postings(given.spark, path), TERM_SETS)
    return found.withColumnRenamed("id", "doc_id")


@query
def grep_index(given: Inputs) -> DataFrame:
    """Points whose key contains a term, by a stored index over the n-grams of all keys."""
    points = lookup.scan_column(given.cells, "POINT", "POJO")
    index = postings.build_postings(postings.key_rows(points), scratch_path(given.spark, "grams"))
    found = [_typed(postings.grep_stored(points, index, term)).withColumn("term", F.lit(term)) for term in GREP_TERMS]
    return reduce(DataFrame.unionByName, found)


@query
def exact_key_filter(given: Inputs) -> DataFrame:
    return lookup.exact_key_filter(given.cells, f"point_{QUERY_UID}", "POINT", "ISCANDIDATE").drop("ts")


@query
def coord_equals(given: Inputs) -> DataFrame:
    return given.points.filter(geometry.same_place(given.q))


@query
def snap_zero(given: Inputs) -> DataFrame:
    """Half of the values are scaled down to where they count as zero."""
    small = F.when(F.col("x") < 75, F.col("y") * 1e-12).otherwise(F.col("y"))
    return given.points.select("uid", geometry.snap_zero(small).alias("snapped"))


@query
def box_window(given: Inputs) -> DataFrame:
    return given.index.points.filter(geometry.inside_window(given.q)).select("uid", "x", "y")


@query
def exclude_query_point(given: Inputs) -> DataFrame:
    return search.without_query(given.points, given.q)


@query
def certain_hits(given: Inputs) -> DataFrame:
    return given.index.certain_hits(given.q, WIDE_RADIUS).select("uid", "x", "y")


@query
def pivot_prune(given: Inputs) -> DataFrame:
    return search.pivot_prune(given.index.points, given.index.pivots, given.q, RADIUS).select("uid", "x", "y")


# Distances to pivots


@query
def pivot_distances(given: Inputs) -> DataFrame:
    return pivots.pivot_distances(given.points, given.index.pivots)


@query
def pivot_distances_wide(given: Inputs) -> DataFrame:
    """The wide form, read back through its map view."""
    wide = pivots.pivot_distances_wide(given.points, given.index.pivots)
    return wide.select("uid", F.explode(pivots.distance_map(given.index.pivots)).alias("pivot_id", "dist"))


@query
def pivot_map_by_pivot(given: Inputs) -> DataFrame:
    """The stored map of every pivot, each read on its own."""
    maps = [
        pivots.read_pivot_map(given.spark, given.pivot_maps, p.pivot_id).withColumn("pivot_id", F.lit(p.pivot_id))
        for p in given.index.pivots
    ]
    return reduce(DataFrame.unionByName, maps)


@query
def diameter_bruteforce(given: Inputs) -> DataFrame:
    """Largest distance over all pairs of points; found without forming the pairs."""
    return hull.diameter(given.points)


@query
def lookup_pivot_distance(given: Inputs) -> DataFrame:
    """Stored distance to the closest pivot, out of the point's own row."""
    near = given.index.points.withColumn("dist", pivots.stored_distance(given.index.pivots, "closest_pivot"))
    return near.select("uid", F.col("closest_pivot").alias("pivot_id"), "dist")


@query
def candidate_fetch(given: Inputs) -> DataFrame:
    marked = search.flagged(given.index.points, given.index.pivots, given.q, RADIUS, "q41")
    return search.candidate_fetch(marked.filter("is_candidate"), given.points)


# Aggregates


@query
def diameter(given: Inputs) -> DataFrame:
    return hull.hull_diameter(given.edges)


@query
def envelope(given: Inputs) -> DataFrame:
    return hull.envelope(given.points)


@query
def convex_hull(given: Inputs) -> DataFrame:
    return hull.hull_vertices(given.edges)


@query
def hull_centroid(given: Inputs) -> DataFrame:
    return _rounded(hull.hull_measures(given.edges), "area", "cx", "cy")


@query
def quadrant_area(given: Inputs) -> DataFrame:
    bounds = (F.col(name) for name in ("min_x", "max_x", "min_y", "max_y"))
    areas = quadrants.quadrant_areas(*bounds, *given.centre)
    rows = F.array(*(F.struct(F.lit(name).alias("name"), area.alias("area")) for name, area in areas.items()))
    return _rounded(hull.envelope(given.points).select(F.inline(rows)), "area")


@query
def quadrant_counts(given: Inputs) -> DataFrame:
    return quadrants.quadrant_counts(given.points, given.centre)


@query
def quadrant_density(given: Inputs) -> DataFrame:
    extent = given.index.extent
    areas = quadrants.quadrant_areas(extent.min_x, extent.max_x, extent.min_y, extent.max_y, extent.cx, extent.cy)
    counts = quadrants.stored_quadrant_counts(given.index.points)
    return _rounded(quadrants.quadrant_table(counts, areas), "area", "density")


@query
def closest_pivot(given: Inputs) -> DataFrame:
    return pivots.closest_pivot(given.points, given.index.pivots).select("uid", "closest_pivot", "dp_closest")


@query
def match_count(given: Inputs) -> DataFrame:
    return search.match_count(given.index.range_query(given.q, RADIUS, ordered=False))


@query
def group_hulls(given: Inputs) -> DataFrame:
    """Vertices of the hull of each kind of event."""
    points = given.events.select("event_type", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    edges = group_hull.group_hulls(points, ["event_type"])
    return edges.select("event_type", F.col("ax").alias("x"), F.col("ay").alias("y"))


@query
def group_diameters(given: Inputs) -> DataFrame:
    """Largest distance within each user's events, by minute of the day and value."""
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("double")
    points = given.events.select("user_id", minute.alias("x"), F.col("value").alias("y"))
    return group_hull.group_diameters(group_hull.group_hulls(points, ["user_id"]), ["user_id"])


# Index


@query
def sss_pivots(given: Inputs) -> DataFrame:
    found = pivots.sss_pivots(given.points, hull.hull_diameter(given.edges).first()[0])
    return pivots.pivots_frame(given.spark, found)


@query
def random_pivots(given: Inputs) -> DataFrame:
    return pivots.random_pivots(given.points, SEED)


@query
def query_pivot_distances(given: Inputs) -> DataFrame:
    return pivots.query_pivot_distances(given.index.pivots_frame(), given.q)


@query
def quadrant_of(given: Inputs) -> DataFrame:
    return given.points.select("uid", geometry.quadrant_of("x", "y", given.centre).alias("quadrant"))


@query(name="build_index")
def fresh_index(given: Inputs) -> DataFrame:
    """Rows, nearest-pivot distances and quadrants of a freshly built index."""
    index = build_index(given.points, scratch_path(given.spark, "fresh-index"))
    return (
        index.points.groupBy("closest_pivot", "quadrant")
        .agg(F.count("*").alias("n"), F.max("dp_closest").alias("farthest"))
    )


@query
def index_update(given: Inputs) -> DataFrame:
    """All points of an index that was built without some of them, with others elsewhere and with strange ones, and then
    brought up to date; and which of them a search in it finds."""
    path, turn = scratch_path(given.spark, "living-index"), F.pmod("uid", F.lit(100))
    late, moved, strange = given.points.filter(turn == 7), given.points.filter(turn == 3), given.points.filter(turn == 50)
    strange = strange.withColumn("uid", -F.col("uid"))
    early = given.points.filter(turn != 7).withColumn("x", F.when(turn == 3, F.col("y") / 2).otherwise(F.col("x")))
    build_index(early.unionByName(strange), path)
    index = upkeep.update_index(given.spark, path, late.unionByName(moved), strange.select("uid"))
    hits = index.range_query(given.q, RADIUS, ordered=False).select("uid", "dist")
    return index.points.select("uid", "x", "y").join(hits, "uid", "left")


# Range search and nearest neighbours


@query
def distance(given: Inputs) -> DataFrame:
    return given.points.select("uid", geometry.distance_to(given.q).alias("dist"))


@query
def refine(given: Inputs) -> DataFrame:
    return search.refine(given.points, given.q, RADIUS)


@query
def range_query(given: Inputs) -> DataFrame:
    return given.index.range_query(given.q, RADIUS, pivot_bounds=True)


@query
def range_query_plain(given: Inputs) -> DataFrame:
    """The same search over points without an index."""
    return search.range_query(given.points, [], given.q, RADIUS)


@query
def range_query_reference(given: Inputs) -> DataFrame:
    return search.certain_range_query(given.index.points, given.index.pivots, given.q, WIDE_RADIUS)


@query
def flag_candidates(given: Inputs) -> DataFrame:
    marked = search.flagged(given.index.points, given.index.pivots, given.q, RADIUS, "q41")
    return marked.select("query_id", "uid", "is_candidate")


@query
def flag_within_range(given: Inputs) -> DataFrame:
    marked = search.flagged(given.index.points, given.index.pivots, given.q, RADIUS, "q41")
    return marked.select("query_id", "uid", "within_range")


@query
def derive_range(given: Inputs) -> DataFrame:
    """Starting radius for each quadrant."""
    return _rounded(
        given.index.quadrants_frame().select("name", geometry.derive_range(NEIGHBOURS, "density").alias("r")), "r"
    )


@query
def initial_range(given: Inputs) -> DataFrame:
    """Starting radius around every point, from the density of its quadrant."""
    return _rounded(given.index.initial_ranges(NEIGHBOURS), "r")


@query(name="knn")
def knn_scan(given: Inputs) -> DataFrame:
    return knn(given.points, given.q, NEIGHBOURS)


@query
def knn_expanding(given: Inputs) -> DataFrame:
    return given.index.knn(given.q, NEIGHBOURS)


# Many query points at once


def _asked(given: Inputs) -> DataFrame:
    """Every hundredth point as a query, with a radius of its own."""
    some = given.points.filter(F.pmod("uid", F.lit(ASKED_EVERY)) == 0)
    return some.select(F.col("uid").alias("query_id"), "x", "y", (F.pmod(F.col("uid") / ASKED_EVERY, F.lit(5)) + 0.5).alias("r"))


@query
def range_join(given: Inputs) -> DataFrame:
    """All points within a radius of each of many query points."""
    return joins.range_join(given.points, _asked(given))


@query
def knn_join(given: Inputs) -> DataFrame:
    """The nearest points of each of many query points, some of them outside of the data."""
    far = given.points.filter(F.pmod("uid", F.lit(ASKED_EVERY)) == 1).select(F.col("uid").alias("query_id"), F.col("x") * 10 - 500, F.col("y") * 7)
    return joins.knn_join(given.points, _asked(given).drop("r").union(far), JOIN_NEIGHBOURS)


# Vectors


def _vectors(given: Inputs) -> DataFrame:
    return given.table("embeddings").select(F.col("vec_id").alias("uid"), F.col("embedding").alias("vector"))


@query
def vector_range(given: Inputs) -> DataFrame:
    """Vectors within a distance of one of them, by an index over all of them."""
    index, q = given.vector_index, _vectors(given).filter(F.col("uid") == QUERY_UID).first()["vector"]
    return _rounded(index.range_query(q, VECTOR_RADIUS), "dist")


@query
def vector_knn(given: Inputs) -> DataFrame:
    """The nearest vectors of one of them, by the same index."""
    q = _vectors(given).filter(F.col("uid") == QUERY_UID).first()["vector"]
    return _rounded(given.vector_index.knn(q, NEIGHBOURS), "dist")


# Order and sets


@query
def sort_xy(given: Inputs) -> DataFrame:
    """Coordinates, some of them missing, with their position in the sorted frame itself."""
    gaps = given.points.withColumns({n: F.when(F.pmod("uid", F.lit(m)) != 0, F.col(n)) for n, m in (("x", 11), ("y", 7))})
    return ordering.numbered(ordering.sort_xy(gaps).select("x", "y"), "position")


@query
def order_by_distance(given: Inputs) -> DataFrame:
    near = given.points.select("uid", geometry.distance_to(given.q).alias("dist"))
    return ordering.numbered(ordering.by_distance(near), "position")


@query
def preview_neighbors(given: Inputs) -> DataFrame:
    return ordering.first_rows(given.index.range_query(given.q, RADIUS, ordered=False), PREVIEW_ROWS, ["dist", "uid"])


@query
def sample_point(given: Inputs) -> DataFrame:
    return ordering.sample_point(given.points, SEED)


@query
def unique_points(given: Inputs) -> DataFrame:
    return ordering.unique_points(given.points)


@query
def distinct_distance(given: Inputs) -> DataFrame:
    return ordering.one_per_distance(search.refine(given.points, given.q, WIDE_RADIUS))


# Scalar functions


@query
def pivot_point_key(given: Inputs) -> DataFrame:
    near = given.index.points
    return near.select("uid", keys.pair_key("closest_pivot", F.col("uid").cast("string")).alias("pair"))


@query
def point_pivot_distance(given: Inputs) -> DataFrame:
    """Distance to every pivot, out of each point's stored map."""
    stored = [
        F.struct(F.lit(p.pivot_id).alias("pivot_id"), streams.point_pivot_distance(p.pivot_id).alias("dist"))
        for p in given.index.pivots
    ]
    return cell_table.read_points(given.cells).select("uid", F.inline(F.array(*stored)))


# Streams


@query
def stream_decode(given: Inputs) -> DataFrame:
    decoded = given.messages.select("uid", "x", "y", F.size("distances").alias("stored"))
    return given.drained(decoded, "decoded")


@query
def stream_range(given: Inputs) -> DataFrame:
    return given.drained(streams.stream_range(given.stream, given.q, RADIUS), "stream-range")


@query
def stream_range_messages(given: Inputs) -> DataFrame:
    """Filter by stored pivot distances, then refine, over JSON messages."""
    kept = streams.stream_prune(given.messages, given.index.pivots, given.q, RADIUS)
    return given.drained(streams.stream_range(kept, given.q, RADIUS), "stream-messages").drop("distances")


@query
def stream_certain_hits(given: Inputs) -> DataFrame:
    kept = streams.stream_certain_hits(given.messages, given.index.pivots, given.q, WIDE_RADIUS)
    return given.drained(kept.select("uid", "x", "y"), "stream-certain")


@query
def stream_match_count(given: Inputs) -> DataFrame:
    counts = streams.stream_match_count(streams.stream_range(given.stream, given.q, RADIUS), "q41")
    path = scratch_path(given.spark, "stream-count")
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return given.spark.read.schema(counts.schema).parquet(f"{path}/out")


def _arriving(given: Inputs, path: str) -> Iterator[DataFrame]:
    """A stream of the points to which a part is added before each time it is yielded."""
    given.points.withColumn("part", F.pmod("uid", F.lit(STOP_FILES))).write.partitionBy("part").parquet(f"{path}/dealt")
    make_folder(given.spark, f"{path}/points")
    stream = given.spark.readStream.schema(given.points.schema).option("recursiveFileLookup", True).parquet(f"{path}/points")
    for part in range(STOP_FILES):
        rename(given.spark, f"{path}/dealt/part={part}", f"{path}/points/{part}")
        yield stream


@query
def stream_stop_at_n(given: Inputs) -> DataFrame:
    """Which batch brought the n-th match, and how many matches there were then. The points are dealt into parts by
    identifier in one pass, and a part arrives for each batch."""
    path = scratch_path(given.spark, "stop")
    for stream in _arriving(given, path):
        report = streams.stream_stop_at_n(streams.stream_range(stream, given.q, RADIUS), STOP_AFTER, f"{path}/query")
        if report.reached:
            break
    row = (report.reached, report.batch_id, report.matches)
    return local_frame(given.spark, [row], "reached boolean, batch bigint, matches bigint")


@query
def stream_knn(given: Inputs) -> DataFrame:
    path = scratch_path(given.spark, "stream-knn")
    streams.stream_knn(given.stream, given.q, NEIGHBOURS, path).awaitTermination()
    return streams.knn_result(given.stream, path)


@query
def stream_metrics(given: Inputs) -> DataFrame:
    """Points and matches of every batch, counted inside the query."""
    path, found = scratch_path(given.spark, "stream-metrics"), []
    for stream in _arriving(given, path):
        writer = streams.observed(stream, given.q, RADIUS).writeStream.format("noop")
        running = writer.option("checkpointLocation", f"{path}/query").trigger(availableNow=True).start()
        running.awaitTermination()
        found += streams.batch_metrics(running)
    return local_frame(given.spark, found, "batch bigint, points bigint, matches bigint")


@query
def stream_window_hits(given: Inputs) -> DataFrame:
    """Matches per hour."""
    path = scratch_path(given.spark, "stream-windows")
    streams.stream_window_hits(given.timed_stream, given.q, RADIUS, "1 hour", "1 day", path).awaitTermination()
    return streams.window_result(given.spark, path).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def stream_live_knn(given: Inputs) -> DataFrame:
    """Nearest points of many queries that live for some days each."""
    path = scratch_path(given.spark, "stream-live")
    asked = as_timed_points(given.events).filter(F.pmod("uid", F.lit(ASKED_EVERY)) == 0)
    asked = asked.select(
        F.col("uid").alias("query_id"), "ts", (F.col("ts") + F.expr(f"INTERVAL {LIVE_DAYS} DAYS")).alias("until"), "x", "y",
        F.lit(LIVE_RADIUS).alias("r"), F.lit(JOIN_NEIGHBOURS).alias("k"),
    )
    asked.write.parquet(f"{path}/queries")
    queries = given.spark.readStream.schema(asked.schema).parquet(f"{path}/queries")
    make_folder(given.spark, f"{path}/ticks")
    ticks = given.spark.readStream.schema(given.timed_stream.schema).parquet(f"{path}/ticks")
    for year in (2100, 2101):  # time goes on until all queries have expired
        tick = given.spark.sql(f"SELECT -1L AS uid, TIMESTAMP'{year}-01-01' AS ts, 0D AS x, 0D AS y")
        tick.write.mode("append").parquet(f"{path}/ticks")
        points = given.timed_stream.unionByName(ticks)
        live.stream_live_knn(points, queries, LIVE_RADIUS, "1 day", f"{path}/query").awaitTermination()
    return live.live_result(given.spark, f"{path}/query")


@query
def stream_timing(given: Inputs) -> DataFrame:
    """Rows that a range search over the stream took in."""
    path = scratch_path(given.spark, "stream-timing")
    writer = streams.stream_range(given.stream, given.q, RADIUS).writeStream.format("noop")
    running = writer.option("checkpointLocation", path).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = streams.stream_timing(running)["rows"]
    return local_frame(given.spark, [(rows,)], "rows bigint")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on the order of addition, so they are compared to six digits."""
    return df.withColumns({name: F.round(name, 6) for name in names})
