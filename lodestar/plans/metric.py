"""Landmark index over vectors of any dimension, by Euclidean distance.

Pivots are chosen as for points: a vector is a pivot when it is at least ``spacing`` from all before it, in order of uid. A
scan brings the first survivors in that order, which name the next pivots exactly, and often many at once. There is no
geometric bound on their number here, so ``most`` is one; with fewer pivots searches read more and find the same.

Every vector is stored with its distances to all pivots as one array, in the order of its nearest pivot and the distance to it.
A search knows its own distances to the pivots. The triangle inequality then says of each pivot's vectors which distances to
that pivot can hold neighbours, and rules out pivots that are too far for being the nearest one. These are range tests on
two stored columns, which reach the scan; the array of distances decides about most of what is left, and the vectors about
the rest.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.session import local_frame
from lodestar.sources.versions import last_version, publish_version, read_version

#: Survivors that one scan brings to the driver, and how many pivots there are at most.
SURVIVORS, MOST_PIVOTS = 256, 64

#: Vectors per file of a stored index.
ROWS_PER_FILE = 500_000

#: Bounds are widened by this share, so that rounding only lets vectors through to the exact test.
SLACK = 1e-9

LISTS = T.ArrayType(T.DoubleType())


def sound(vector: str = "vector", size: int | None = None) -> Column:
    """All components are finite numbers, and as many as they should be."""
    finite = F.forall(vector, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    right = F.size(vector) > 0 if size is None else F.size(vector) == size
    return F.coalesce(finite & right, F.lit(False))


def distances_to(places: list[list[float]]):
    """The distances of a vector to some places, as an array."""
    targets = np.array(places, np.float64)

    @F.arrow_udf(LISTS)
    def measure(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, targets.shape[1]))
        out = np.stack([np.sqrt(((flat - place) ** 2).sum(axis=1)) for place in targets], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(targets), pa.int32()), pa.array(out.ravel()))

    return measure


def select_pivots(vectors: DataFrame, spacing: float, most: int = MOST_PIVOTS) -> list[tuple[object, list[float]]]:
    """``(uid, vector)`` of the pivots: the sequential choice in order of uid, up to ``most``."""
    pivots: list[tuple[object, list[float]]] = []
    while len(pivots) < most:
        left = vectors
        if pivots:
            near = distances_to([place for _, place in pivots])("vector")
            left = vectors.withColumn("_near", F.array_min(near)).filter(F.col("_near") >= spacing)
        rows = left.select("uid", "vector").orderBy("uid").limit(SURVIVORS).collect()
        before = len(pivots)
        for row in rows:
            place = np.array(row["vector"])
            if len(pivots) < most and all(math.sqrt(((place - np.array(p)) ** 2).sum()) >= spacing for _, p in pivots):
                pivots.append((row["uid"], list(row["vector"])))
        if len(pivots) == before:
            break
    return pivots


@dataclass(frozen=True)
class VectorIndex:
    """Stored vectors ``uid, vector, distances, cluster, near``, the pivots, and per cluster its size and range of ``near``."""

    vectors: DataFrame
    pivots: list[list[float]]
    clusters: dict[int, tuple[int, float, float]]

    def _to_pivots(self, q: list[float]) -> list[float]:
        return [float(d) for d in np.sqrt(((np.array(self.pivots) - np.array(q, np.float64)) ** 2).sum(axis=1))]

    def candidates(self, q: list[float], r: float) -> DataFrame:
        """Vectors that the pivots cannot rule out, by the two columns that reach the scan."""
        to = self._to_pivots(q)
        wide = r + SLACK * (1 + r + max(to))
        parts = []
        for cluster, (_, low, high) in self.clusters.items():
            d = to[cluster]
            # The pivot is the nearest one of its vectors, so it cannot be much farther from q than q's own.
            if d - wide > high or d + wide < low or d - min(to) > 2 * wide:
                continue
            parts.append((F.col("cluster") == cluster) & F.col("near").between(d - wide, d + wide))
        return self.vectors.filter(reduce(lambda a, b: a | b, parts, F.lit(False)))

    def range_query(self, q: list[float], r: float) -> DataFrame:
        """``(uid, dist)`` of all vectors within r of q, in no order."""
        to = self._to_pivots(q)
        wide = r + SLACK * (1 + r + max(to))
        apart = F.zip_with("distances", F.array(*map(F.lit, to)), lambda d, dq: F.abs(d - dq))
        left = self.candidates(q, r).filter(F.array_max(apart) <= wide)
        found = left.select("uid", F.get(distances_to([list(q)])("vector"), F.lit(0)).alias("dist"))
        return found.filter(F.col("dist") <= F.lit(float(r)))

    def knn(self, q: list[float], k: int) -> DataFrame:
        """The k nearest vectors ``(uid, dist)``, nearest first, ties by uid.

        The clusters nearest to q that hold k vectors give a radius that is sure to hold k; a range query does the rest.
        """
        if k <= 0:
            return self.range_query(q, 0.0).limit(0)
        to, chosen, held = self._to_pivots(q), [], 0
        for cluster in sorted(self.clusters, key=lambda c: to[c]):
            chosen.append(cluster)
            held += self.clusters[cluster][0]
            if held >= k:
                break
        near = self.vectors.filter(F.col("cluster").isin(chosen))
        dist = F.get(distances_to([list(q)])("vector"), F.lit(0)).alias("dist")
        radius = near.select(dist, "uid").orderBy("dist", "uid").limit(k).agg(F.max("dist")).first()[0]
        return self.range_query(q, radius if radius is not None else 0.0).orderBy("dist", "uid").limit(k)

    def rows_read(self, q: list[float], r: float) -> dict[str, int]:
        """Vectors that are stored, that the scan cannot skip, and that are measured against q."""
        to = self._to_pivots(q)
        wide = r + SLACK * (1 + r + max(to))
        apart = F.array_max(F.zip_with("distances", F.array(*map(F.lit, to)), lambda d, dq: F.abs(d - dq)))
        row = self.candidates(q, r).agg(F.count("*").alias("read"), F.count_if(apart <= wide).alias("measured")).first()
        return {"stored": sum(n for n, _, _ in self.clusters.values()), **row.asDict()}


def build_vector_index(vectors: DataFrame, path: str, spacing: float, most: int = MOST_PIVOTS, rows_per_file: int = ROWS_PER_FILE) -> VectorIndex:
    """Store vectors ``(uid, vector)`` with their distances to pivots that are ``spacing`` apart.

    All vectors must have the length of the first one by uid that is sound; others, and those that hold null or
    non-finite components, are left out.
    """
    spark = vectors.sparkSession
    before = last_version(spark, path)
    vectors = vectors.select("uid", F.col("vector").cast(LISTS).alias("vector")).filter(F.col("uid").isNotNull() & sound())
    first = vectors.orderBy("uid").limit(1).collect()
    if not first:
        raise ValueError("no vectors with finite components")
    vectors = vectors.filter(F.size("vector") == len(first[0]["vector"]))
    pivots = [place for _, place in select_pivots(vectors, spacing, most)]
    placed = vectors.withColumn("distances", distances_to(pivots)("vector"))
    placed = placed.withColumn("near", F.array_min("distances")).withColumn("cluster", (F.array_position("distances", F.col("near")) - 1).cast("int"))
    files = max(1, math.ceil(vectors.count() / rows_per_file))
    folder = f"vectors-{uuid.uuid4().hex}"
    spread = placed.repartitionByRange(files, "cluster", "near", F.xxhash64("uid")).sortWithinPartitions("cluster", "near")
    spread.select("uid", "vector", "distances", "cluster", "near").write.parquet(f"{path}/{folder}")
    stored = spark.read.parquet(f"{path}/{folder}")
    rows = stored.groupBy("cluster").agg(F.count("*"), F.min("near"), F.max("near")).collect()
    content = {"folder": folder, "pivots": pivots, "clusters": [list(row) for row in rows]}
    publish_version(spark, path, before, content)
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The last version of a stored index."""
    content = read_version(spark, path)[1]
    clusters = {cluster: (n, low, high) for cluster, n, low, high in content["clusters"]}
    return VectorIndex(spark.read.parquet(f"{path}/{content['folder']}"), content["pivots"], clusters)


def scan_knn(vectors: DataFrame, q: list[float], k: int) -> DataFrame:
    """The k nearest vectors without an index."""
    right = vectors.select("uid", F.col("vector").cast(LISTS).alias("vector")).filter(sound("vector", len(q)))
    dist = F.get(distances_to([list(q)])("vector"), F.lit(0)).alias("dist")
    return right.select("uid", dist).orderBy("dist", "uid").limit(k) if k > 0 else local_frame(vectors.sparkSession, [], right.select("uid", dist).schema)
