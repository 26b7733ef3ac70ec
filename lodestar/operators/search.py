"""Range search: certain hits, lower-bound pruning, refinement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geometry import Location, distance_to, plain_distance, same_place
from lodestar.operators.ordering import by_distance, one_per_distance
from lodestar.operators.pivots import Pivot
from lodestar.session import written

# Pruning bounds are widened by this share, so rounding can only let a point through to the exact test.
SLACK = 1e-9

EXCLUDE_COORDS = "coords"
EXCLUDE_UID = "uid"
EXCLUDE_NONE = "none"


def refine(candidates: DataFrame, q: Location, r: float) -> DataFrame:
    """Candidates at distance at most r, with the distance."""
    return candidates.withColumn("dist", distance_to(q)).filter(F.col("dist") <= F.lit(float(r)))


def without_query(found: DataFrame, q: Location, exclude: str = EXCLUDE_COORDS, uid=None) -> DataFrame:
    """Leave out the query point: everything at its coordinates, one uid, or nothing."""
    if exclude == EXCLUDE_COORDS:
        return found.filter(~same_place(q))
    if exclude == EXCLUDE_UID:
        return found.filter(F.col("uid") != F.lit(uid))
    if exclude == EXCLUDE_NONE:
        return found
    raise ValueError(f"exclude must be coords, uid or none, not {exclude!r}")


def box_bound(q: Location, r: float) -> Column:
    """The square around the query disc."""
    wide = r + SLACK * (1 + r + abs(q[0]) + abs(q[1]))
    return F.col("x").between(q[0] - wide, q[0] + wide) & F.col("y").between(q[1] - wide, q[1] + wide)


def pivot_bound(pivots: list[Pivot], q: Location, r: float) -> Column:
    """Triangle inequality: a point with |d(q,p) - d(p,x)| > r for some pivot p is farther than r."""
    bounds = []
    for p in pivots:
        dq = plain_distance(p.place, q)
        wide = r + SLACK * (1 + r + dq)
        bounds.append(F.col(f"dp_{p.ord}").between(dq - wide, dq + wide))
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def pivot_prune(indexed: DataFrame, pivots: list[Pivot], q: Location, r: float) -> DataFrame:
    """Points that the pivots cannot rule out: all true neighbours and some others.

    The bounds are range tests on stored columns; they reach the Parquet scan and skip row groups.
    """
    return indexed.filter(pivot_bound(pivots, q, r))


def certain_hits(indexed: DataFrame, pivots: list[Pivot], q: Location, r: float) -> DataFrame:
    """Points that are surely within r: r >= d(q,p) + d(p,x) for the closest pivot p of x.

    An acceptance test. Every row is a neighbour, but most neighbours are not among the rows.
    """
    to_query = [plain_distance(p.place, q) for p in pivots]
    reachable = F.col("dp_closest") <= F.lit(r - min(to_query) + SLACK * (1 + r))
    dq = F.element_at(F.array(*map(F.lit, to_query)), F.col("closest_ord") + 1)
    return indexed.filter(reachable & (F.lit(float(r)) >= dq + F.col("dp_closest")))


def within(indexed: DataFrame, pivots: list[Pivot], q: Location, r: float) -> DataFrame:
    """All points within r of q, unordered: box and pivot bounds at the scan, exact test after it."""
    return refine(pivot_prune(indexed.filter(box_bound(q, r)), pivots, q, r), q, r)


def range_query(
    indexed: DataFrame,
    pivots: list[Pivot],
    q: Location,
    r: float,
    exclude: str = EXCLUDE_COORDS,
    uid=None,
    ordered: bool = True,
) -> DataFrame:
    """Exact range search: ``(uid, x, y, dist)``, nearest first. Without pivots it scans plain points."""
    found = without_query(within(indexed, pivots, q, r), q, exclude, uid).select("uid", "x", "y", "dist")
    return by_distance(found) if ordered else found


def certain_range_query(indexed: DataFrame, pivots: list[Pivot], q: Location, r: float) -> DataFrame:
    """Certain hits only, refined, and one row per distance."""
    hits = without_query(refine(certain_hits(indexed, pivots, q, r), q, r), q)
    return one_per_distance(hits).orderBy("dist")


def flagged(indexed: DataFrame, pivots: list[Pivot], q: Location, r: float, query_id: str) -> DataFrame:
    """Candidate and result marks of one query for all points, keyed by the query."""
    near = pivot_bound(pivots, q, r)
    hit = (distance_to(q) <= F.lit(float(r))) & ~same_place(q)
    return indexed.select(
        F.lit(query_id).alias("query_id"), "uid", near.alias("is_candidate"), (near & hit).alias("within_range")
    )


def candidate_fetch(candidates: DataFrame, points: DataFrame) -> DataFrame:
    """Point rows of candidate identifiers. The identifiers are written first, so the join knows their size."""
    return points.join(written(candidates.select("uid"), "candidates"), "uid", "left_semi")


def match_count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("matches"))
