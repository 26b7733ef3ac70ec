"""Independent SQL for every query of the registry: what the tables say, by the plainest statement."""

from __future__ import annotations

from lodestar.constants import (
    ALPHA,
    EPSILON,
    GEO_X_HIGH,
    GEO_X_LOW,
    GEO_Y_HIGH,
    GEO_Y_LOW,
    POINT_COUNT_ROW,
    PREVIEW_ROWS,
    QUADRANT_ROW,
    RANDOM_PIVOT_DRAWS,
    RANDOM_PIVOT_POOL,
)
from lodestar.plans.registry import ASKED_EVERY, GREP_TERMS, JOIN_NEIGHBOURS, LIVE_DAYS, LIVE_RADIUS, NEIGHBOURS, QUERY_UID, RADIUS, SEED, STOP_AFTER, STOP_FILES, TERM_SETS, TERMS, VECTOR_RADIUS, WIDE_RADIUS
from lodestar.sources.generators import FRACTION_BITS, FRACTION_DIGITS

# Building blocks. Each names those it needs, in order.

POINTS = "p AS (SELECT event_id AS uid, CAST(user_id AS DOUBLE) AS x, value AS y FROM events)"

QUERY_POINT = f"q AS (SELECT x AS qx, y AS qy FROM p WHERE uid = {QUERY_UID})"

NEAR = """near AS (
    SELECT uid, x, y, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS dist, (x = qx AND y = qy) AS is_query
    FROM p, q
)"""

# For each x only the lowest and the highest point can be a vertex of the hull or an end of the diameter.
OUTER = """outer_points AS (
    SELECT DISTINCT x, y
    FROM (SELECT x, min(y) AS y FROM p GROUP BY x UNION ALL SELECT x, max(y) AS y FROM p GROUP BY x)
)"""

DIAMETER = """diam AS (
    SELECT max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS m
    FROM outer_points a, outer_points b
)"""

# Counter-clockwise edges: no point to the right, and no point on the line beyond either end.
HULL = """edges AS (
    SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM outer_points a, outer_points b
    WHERE (a.x <> b.x OR a.y <> b.y) AND NOT EXISTS (
        SELECT 1 FROM outer_points c
        WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
        OR (
            (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
            AND NOT (
                c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x)
                AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)
            )
        )
    )
)"""

SHAPE = """shape AS (
    SELECT sum(x1 * y2 - x2 * y1) / 2 AS area,
        sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx,
        sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy,
        count(*) AS vertices
    FROM edges
)"""

QUADRANT = """placed AS (
    SELECT uid, x, y, CASE
        WHEN x <= cx AND y >= cy THEN 'UPPER LEFT'
        WHEN x >= cx AND y >= cy THEN 'UPPER RIGHT'
        WHEN x >= cx AND y <= cy THEN 'LOWER RIGHT'
        ELSE 'LOWER LEFT' END AS quadrant
    FROM p, shape
)"""

AREAS = """areas AS (
    SELECT 'UPPER LEFT' AS name, (cx - min_x) * (max_y - cy) AS area FROM bounds, shape
    UNION ALL SELECT 'UPPER RIGHT', (max_x - cx) * (max_y - cy) FROM bounds, shape
    UNION ALL SELECT 'LOWER RIGHT', (max_x - cx) * (cy - min_y) FROM bounds, shape
    UNION ALL SELECT 'LOWER LEFT', (cx - min_x) * (cy - min_y) FROM bounds, shape
)"""

BOUNDS = "bounds AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p)"

QUADRANTS = """quadrants AS (
    SELECT name, area, n, n / area AS density
    FROM (
        SELECT name, any_value(area) AS area, count(uid) AS n
        FROM areas LEFT JOIN placed ON quadrant = name GROUP BY name
    )
)"""

# The greedy choice: next comes the first point that no chosen pivot is too close to.
PIVOTS = f"""chosen AS (
    SELECT 0 AS step, [min(struct_pack(uid := uid, x := x, y := y))] AS ps FROM p
    UNION ALL
    SELECT step + 1, list_append(any_value(ps), min(struct_pack(uid := uid, x := x, y := y)))
    FROM chosen, p, diam
    WHERE len(list_filter(ps, lambda s:
        NOT (sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) >= {ALPHA} * diam.m))) = 0
    GROUP BY step
),
pivots AS (
    SELECT 'pivot_' || CAST(i - 1 AS VARCHAR) AS pivot_id, CAST(i - 1 AS INTEGER) AS ord,
        s.uid AS uid, s.x AS x, s.y AS y
    FROM (
        SELECT unnest(ps) AS s, generate_subscripts(ps, 1) AS i
        FROM chosen WHERE step = (SELECT max(step) FROM chosen)
    )
)"""

PAIRS = """pairs AS (
    SELECT pivot_id, ord, p.uid AS uid, p.x AS x, p.y AS y,
        sqrt((p.x - pivots.x) * (p.x - pivots.x) + (p.y - pivots.y) * (p.y - pivots.y)) AS dist
    FROM p, pivots
)"""

CLOSEST = """closest AS (
    SELECT uid, any_value(x) AS x, any_value(y) AS y,
        arg_min(pivot_id, struct_pack(d := dist, o := ord)) AS pivot_id, min(dist) AS dist
    FROM pairs GROUP BY uid
)"""

PIVOT_QUERY = """to_query AS (
    SELECT pivot_id, ord, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) AS dq FROM pivots, q
)"""

CERTAIN = f"""certain AS (
    SELECT uid, x, y FROM closest JOIN to_query USING (pivot_id) WHERE {WIDE_RADIUS} >= dq + dist
)"""

PRUNED = f"""pruned AS (
    SELECT uid, any_value(x) AS x, any_value(y) AS y
    FROM pairs JOIN to_query USING (pivot_id)
    GROUP BY uid HAVING bool_and(abs(dq - dist) <= {RADIUS} + 1e-9 * (1 + {RADIUS} + dq))
)"""

HIT_CELLS = f"""cells AS (
    SELECT 'point_' || CAST(uid AS VARCHAR) AS row, 'POINT' AS cf, 'POJO' AS cq, 1 AS ts FROM p
    UNION ALL SELECT 'point_' || CAST(uid AS VARCHAR), 'POINT', 'ISCANDIDATE', 2 FROM pruned
    UNION ALL SELECT 'point_' || CAST(uid AS VARCHAR), 'POINT', 'WITHINRANGE', 2 FROM near
        WHERE dist <= {RADIUS} AND NOT is_query
)"""

_PIVOTS = [POINTS, OUTER, DIAMETER, PIVOTS]
_PAIRS = [*_PIVOTS, PAIRS]
_CLOSEST = [*_PAIRS, CLOSEST]
_NEAR = [POINTS, QUERY_POINT, NEAR]
_SHAPE = [POINTS, OUTER, HULL, SHAPE]
_PLACED = [*_SHAPE, QUADRANT]
_QUADRANTS = [*_PLACED, BOUNDS, AREAS, QUADRANTS]
_CERTAIN = [*_CLOSEST, QUERY_POINT, PIVOT_QUERY, CERTAIN]
_PRUNED = [*_PAIRS, QUERY_POINT, PIVOT_QUERY, PRUNED]
_CELLS = [*_PRUNED, NEAR, HIT_CELLS]


#: One row per event, numbered from 0.
_MADE = "(SELECT unnest(range(n)) AS i FROM (SELECT count(*) AS n FROM events))"


def _fraction(number: str, purpose: str) -> str:
    """The generators' number in [0, 1)."""
    digits = f"substr(md5('{SEED}|' || {number} || '|{purpose}'), 1, {FRACTION_DIGITS})"
    return f"(CAST(('0x' || {digits}) AS BIGINT)::DOUBLE / {1 << FRACTION_BITS}.0::DOUBLE)"


def _with(blocks: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(blocks)} {select}"


_NAMED = "'point_' || CAST(uid AS VARCHAR)"
_POINT_CELL = f"SELECT {_NAMED} AS row, 'POINT' AS cf, 'POJO' AS cq, x, y FROM p"
_HITS = f"FROM near WHERE dist <= {RADIUS} AND NOT is_query"
_NEAREST = f"SELECT uid, x, y, dist FROM near WHERE NOT is_query ORDER BY dist, uid LIMIT {NEIGHBOURS}"
_QUADRANT_ROWS = "SELECT name, round(area, 6) AS area, n, round(density, 6) AS density FROM quadrants"
_START = f"sqrt({NEIGHBOURS} / (density * pi()))"

_VECTORS = f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {QUERY_UID}),
    m AS (SELECT vec_id AS uid, sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM embeddings, q) """

_APART = "sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy))"

ORACLES: dict[str, str] = {
    # Sources and sinks
    "load_points_delimited": _with([POINTS], f"SELECT {_NAMED} AS uid, x, y FROM p"),
    "load_points_tsv": _with(
        [POINTS], "SELECT 'point_' || CAST(row_number() OVER (ORDER BY uid) - 1 AS VARCHAR) AS uid, x, y FROM p"
    ),
    "load_points": _with(
        [POINTS],
        """SELECT 'point_' || CAST(row_number() OVER (ORDER BY uid) - 1 AS VARCHAR) AS uid, x, y, source
        FROM p, (VALUES ('delimited'), ('tsv')) AS s(source) WHERE source = 'tsv'
        UNION ALL
        SELECT 'point_' || CAST(row_number() OVER (ORDER BY uid) - 1 AS VARCHAR), x, y, 'delimited' FROM p""",
    ),
    "assign_uid_seq": _with(
        [POINTS], "SELECT 'point_' || CAST(row_number() OVER (ORDER BY uid) - 1 AS VARCHAR) AS point_uid, uid FROM p"
    ),
    "assign_uid_hashed": _with([POINTS], "SELECT uid, sha256(CAST(uid AS VARCHAR)) AS hashed FROM p"),
    "dataset_count": _with([POINTS], "SELECT count(*) AS n FROM p"),
    "encode_json": _with(
        [POINTS],
        "SELECT uid, CAST(to_json({'x': x, 'y': y, 'UID': CAST(uid AS VARCHAR)}) AS VARCHAR) AS value FROM p",
    ),
    "decode_json": _with([POINTS], f"SELECT {_NAMED} AS uid, x, y FROM p"),
    "write_points": _with(_CLOSEST, "SELECT uid, x, y, pivot_id AS closest_pivot FROM closest"),
    "upsert_points": """
        SELECT event_id AS uid, CAST(user_id + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS DOUBLE) AS x,
            value AS y, CAST(CASE WHEN event_type = 'click' THEN 11 ELSE 10 END AS INTEGER) AS ts
        FROM events
        UNION ALL
        SELECT -event_id - 1, CAST(user_id AS DOUBLE), value, 11 FROM events WHERE event_type = 'purchase'""",
    "latest_cells": _with(
        _CELLS,
        f"""SELECT row, cf, cq, CAST(ts AS BIGINT) AS ts, CASE WHEN cq = 'POJO' THEN x END AS x, CASE WHEN cq = 'POJO' THEN y END AS y
        FROM cells JOIN p ON row = {_NAMED}
        UNION ALL SELECT pivot_id, 'PIVOT', 'POJO', 1, NULL, NULL FROM pivots
        UNION ALL SELECT '{QUADRANT_ROW}', cf, cq, 1, NULL, NULL
        FROM (VALUES ('UPPER', 'LEFT'), ('UPPER', 'RIGHT'), ('LOWER', 'RIGHT'), ('LOWER', 'LEFT'), ('CENTROID', 'POINT')) v(cf, cq)
        UNION ALL SELECT '{POINT_COUNT_ROW}', 'DATASET', 'COUNT', 1, NULL, NULL""",
    ),
    "write_pivots": _with(_PIVOTS, "SELECT pivot_id, ord, uid, x, y FROM pivots"),
    "read_pivots": _with(_PIVOTS, "SELECT pivot_id, ord, CAST(uid AS VARCHAR) AS uid, x, y FROM pivots"),
    "write_quadrants": _with(_QUADRANTS, _QUADRANT_ROWS),
    "read_quadrant": _with(_QUADRANTS, _QUADRANT_ROWS),
    "read_centroid": _with(_SHAPE, "SELECT round(cx, 6) AS x, round(cy, 6) AS y FROM shape"),
    "ensure_table": _with([POINTS], "SELECT uid, x, y FROM p"),
    "recreate_table": _with([POINTS], "SELECT uid, x + 1 AS x, y FROM p"),
    "publish_points": _with([POINTS], "SELECT CAST(uid AS VARCHAR) AS uid, x, y FROM p"),
    "stream_points": _with([POINTS], "SELECT CAST(uid AS VARCHAR) AS uid, x, y FROM p"),
    "scan_count": _with(_CELLS, "SELECT count(*) AS cells FROM cells"),
    "scan_first": _with(
        _CELLS, "SELECT row, cf, cq, CAST(ts AS BIGINT) AS ts FROM cells ORDER BY row, cf, cq LIMIT 1"
    ),
    "write_wkt": _with([POINTS], "SELECT printf('\"Point (%.2f %.2f)\"', x, y) AS line FROM p"),
    "gen_uniform": f"""SELECT i AS uid, {_fraction("i", "x")} * 10.0 + -5.0 AS x, {_fraction("i", "y")} * 10.0 + -5.0 AS y
        FROM {_MADE}""",
    "gen_geo": f"""SELECT 'point_' || i AS uid,
        -({_fraction("i", "x")} * {GEO_X_HIGH - GEO_X_LOW!r}::DOUBLE + {GEO_X_LOW}::DOUBLE) AS x,
        {_fraction("i", "y")} * {GEO_Y_HIGH - GEO_Y_LOW!r}::DOUBLE + {GEO_Y_LOW}::DOUBLE AS y FROM {_MADE}""",
    # Filters and lookups
    "scan_column": _with([POINTS], _POINT_CELL),
    "lookup_row": _with([POINTS], f"{_POINT_CELL} WHERE uid = {QUERY_UID}"),
    "lookup_row_family": _with(
        _CELLS, f"SELECT row, cf, cq, CAST(ts AS BIGINT) AS ts FROM cells WHERE row = 'point_{QUERY_UID}'"
    ),
    "lookup_prefix": _with([POINTS], f"{_POINT_CELL} WHERE starts_with({_NAMED}, 'point_4')"),
    "lookup_key_range": _with(
        _CELLS,
        """SELECT row, cf, cq FROM cells
        WHERE (row > 'point_2' OR (row = 'point_2' AND (cf > 'POINT' OR (cf = 'POINT' AND cq >= 'ISCANDIDATE'))))
        AND (row < 'point_7' OR (row = 'point_7' AND (cf < 'POINT' OR (cf = 'POINT' AND cq <= 'POJO'))))""",
    ),
    "batch_lookup": _with(
        [POINTS], f"{_POINT_CELL} WHERE uid IN (SELECT event_id FROM events WHERE event_type = 'purchase')"
    ),
    "term_intersect": "SELECT doc_id FROM documents WHERE "
    + " AND ".join(f"list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), '{term}')" for term in TERMS),
    "term_postings": " UNION ALL ".join(
        f"SELECT '{' '.join(terms)}' AS terms, doc_id FROM documents WHERE "
        + " AND ".join(f"list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), '{term}')" for term in terms)
        for terms in TERM_SETS
    ),
    "grep_index": _with(
        [POINTS],
        f"SELECT c.*, term FROM ({_POINT_CELL}) c, (VALUES {', '.join(f"('{term}')" for term in GREP_TERMS)}) t(term) WHERE contains(row, term)",
    ),
    "grep_key": _with([POINTS], f"{_POINT_CELL} WHERE contains({_NAMED}, '_41')"),
    "exact_key_filter": _with(
        _CELLS,
        f"""SELECT row, cf, cq, 'TRUE' AS value FROM cells
        WHERE row = 'point_{QUERY_UID}' AND cf = 'POINT' AND cq = 'ISCANDIDATE'""",
    ),
    "coord_equals": _with([POINTS, QUERY_POINT], "SELECT uid, x, y FROM p, q WHERE x = qx AND y = qy"),
    "snap_zero": _with(
        [POINTS],
        f"""SELECT uid, CASE WHEN abs(v) <= {EPSILON} THEN 0.0 ELSE v END AS snapped
        FROM (SELECT uid, CASE WHEN x < 75 THEN y * 1e-12 ELSE y END AS v FROM p)""",
    ),
    "box_window": _with(
        [POINTS, QUERY_POINT],
        """SELECT uid, x, y FROM p, q
        WHERE x > qx - 154.5 AND x < qx + 154.5 AND y > qy - 154.5 AND y < qy + 154.5""",
    ),
    "exclude_query_point": _with([POINTS, QUERY_POINT], "SELECT uid, x, y FROM p, q WHERE NOT (x = qx AND y = qy)"),
    "certain_hits": _with(_CERTAIN, "SELECT uid, x, y FROM certain"),
    "pivot_prune": _with(_PRUNED, "SELECT uid, x, y FROM pruned"),
    # Distances to pivots
    "pivot_distances": _with(_PAIRS, "SELECT pivot_id, uid, dist FROM pairs"),
    "pivot_distances_wide": _with(_PAIRS, "SELECT uid, pivot_id, dist FROM pairs"),
    "pivot_map_by_pivot": _with(_PAIRS, "SELECT pivot_id, uid, dist FROM pairs"),
    "diameter_bruteforce": _with(
        [POINTS, "u AS (SELECT DISTINCT x, y FROM p)"],
        """SELECT max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS diameter
        FROM u a, u b WHERE a.x <> b.x OR a.y <> b.y""",
    ),
    "lookup_pivot_distance": _with(_CLOSEST, "SELECT uid, pivot_id, dist FROM closest"),
    "candidate_fetch": _with(_PRUNED, "SELECT uid, x, y FROM pruned"),
    # Aggregates
    "diameter": _with([POINTS, OUTER, DIAMETER], "SELECT m AS diameter FROM diam"),
    "envelope": _with([POINTS, BOUNDS], "SELECT min_x, max_x, min_y, max_y FROM bounds"),
    "convex_hull": _with([POINTS, OUTER, HULL], "SELECT x1 AS x, y1 AS y FROM edges"),
    "hull_centroid": _with(
        _SHAPE, "SELECT round(area, 6) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy, vertices FROM shape"
    ),
    "quadrant_area": _with([*_SHAPE, BOUNDS, AREAS], "SELECT name, round(area, 6) AS area FROM areas"),
    "quadrant_counts": _with(_QUADRANTS, "SELECT name, n FROM quadrants"),
    "quadrant_density": _with(_QUADRANTS, _QUADRANT_ROWS),
    "closest_pivot": _with(_CLOSEST, "SELECT uid, pivot_id AS closest_pivot, dist AS dp_closest FROM closest"),
    "match_count": _with(_NEAR, f"SELECT count(*) AS matches {_HITS}"),
    "group_hulls": """
        WITH p AS (SELECT event_type AS g, CAST(user_id AS DOUBLE) AS x, value AS y FROM events),
        o AS (SELECT DISTINCT g, x, y FROM (SELECT g, x, min(y) AS y FROM p GROUP BY g, x UNION ALL SELECT g, x, max(y) FROM p GROUP BY g, x))
        SELECT DISTINCT a.g AS event_type, a.x, a.y
        FROM o a JOIN o b ON a.g = b.g AND (a.x <> b.x OR a.y <> b.y)
        WHERE NOT EXISTS (
            SELECT 1 FROM o c
            WHERE c.g = a.g AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
            OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0
                AND NOT (c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)))))""",
    "group_diameters": """
        WITH p AS (SELECT DISTINCT user_id AS g, CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS x, value AS y FROM events)
        SELECT a.g AS user_id, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS diameter
        FROM p a JOIN p b ON a.g = b.g GROUP BY a.g""",
    # Index
    "sss_pivots": _with(_PIVOTS, "SELECT pivot_id, ord, uid, x, y FROM pivots"),
    "random_pivots": _with(
        [
            POINTS,
            f"""pool AS (
                SELECT *, row_number() OVER (ORDER BY uid) - 1 AS position FROM p ORDER BY uid LIMIT {RANDOM_PIVOT_POOL}
            )""",
        ],
        f"""SELECT 'pivot_' || i AS pivot_id, CAST(i AS INTEGER) AS ord, uid, x, y
        FROM unnest(range({RANDOM_PIVOT_DRAWS})) AS d(i)
        JOIN pool ON position = CAST(floor({_fraction("i", "pivot")} * (SELECT count(*) FROM pool)) AS BIGINT)""",
    ),
    "query_pivot_distances": _with(
        [*_PIVOTS, QUERY_POINT, PIVOT_QUERY], "SELECT pivot_id, ord, dq AS dist FROM to_query"
    ),
    "quadrant_of": _with(_PLACED, "SELECT uid, quadrant FROM placed"),
    "build_index": _with(
        [*_CLOSEST, HULL, SHAPE, QUADRANT],
        """SELECT pivot_id AS closest_pivot, quadrant, count(*) AS n, max(dist) AS farthest
        FROM closest JOIN placed USING (uid) GROUP BY pivot_id, quadrant""",
    ),
    "index_update": _with(_NEAR, f"SELECT uid, x, y, CASE WHEN dist <= {RADIUS} AND NOT is_query THEN dist END AS dist FROM near"),
    # Range search and nearest neighbours
    "distance": _with(_NEAR, "SELECT uid, dist FROM near"),
    "refine": _with(_NEAR, f"SELECT uid, x, y, dist FROM near WHERE dist <= {RADIUS}"),
    "range_query": _with(_NEAR, f"SELECT uid, x, y, dist {_HITS}"),
    "range_query_plain": _with(_NEAR, f"SELECT uid, x, y, dist {_HITS}"),
    "range_query_reference": _with(
        [*_CERTAIN, NEAR],
        f"""SELECT min(uid) AS uid, arg_min(x, uid) AS x, arg_min(y, uid) AS y, dist
        FROM near WHERE uid IN (SELECT uid FROM certain) AND dist <= {WIDE_RADIUS} AND NOT is_query GROUP BY dist""",
    ),
    "flag_candidates": _with(
        _PRUNED, "SELECT 'q41' AS query_id, uid, uid IN (SELECT uid FROM pruned) AS is_candidate FROM p"
    ),
    "flag_within_range": _with(
        _NEAR, f"SELECT 'q41' AS query_id, uid, dist <= {RADIUS} AND NOT is_query AS within_range FROM near"
    ),
    "derive_range": _with(_QUADRANTS, f"SELECT name, round({_START}, 6) AS r FROM quadrants"),
    "initial_range": _with(
        _QUADRANTS, f"SELECT uid, round({_START}, 6) AS r FROM placed JOIN quadrants ON name = quadrant"
    ),
    "knn": _with(_NEAR, _NEAREST),
    "knn_expanding": _with(_NEAR, _NEAREST),
    "range_join": _with(
        [POINTS, f"asked AS (SELECT uid AS query_id, x AS qx, y AS qy, uid / {ASKED_EVERY} % 5 + 0.5 AS r FROM p WHERE uid % {ASKED_EVERY} = 0)"],
        f"""SELECT query_id, uid, x, y, {_APART} AS dist FROM p, asked
        WHERE {_APART} <= r AND (x <> qx OR y <> qy)""",
    ),
    "knn_join": _with(
        [
            POINTS,
            f"""asked AS (
                SELECT uid AS query_id, x AS qx, y AS qy FROM p WHERE uid % {ASKED_EVERY} = 0
                UNION ALL SELECT uid, x * 10 - 500, y * 7 FROM p WHERE uid % {ASKED_EVERY} = 1
            )""",
        ],
        f"""SELECT query_id, uid, x, y, {_APART} AS dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_APART}, uid) AS INTEGER) AS rank
        FROM p, asked WHERE x <> qx OR y <> qy QUALIFY rank <= {JOIN_NEIGHBOURS}""",
    ),
    "vector_range": _VECTORS + f"SELECT uid, round(d, 6) AS dist FROM m WHERE d <= {VECTOR_RADIUS}",
    "vector_knn": _VECTORS + f"SELECT uid, round(d, 6) AS dist FROM m ORDER BY d, uid LIMIT {NEIGHBOURS}",
    # Order and sets
    "sort_xy": _with(
        [POINTS, "gaps AS (SELECT CASE WHEN uid % 11 <> 0 THEN x END AS x, CASE WHEN uid % 7 <> 0 THEN y END AS y FROM p)"],
        "SELECT x, y, row_number() OVER (ORDER BY x NULLS FIRST, y NULLS FIRST) - 1 AS position FROM gaps",
    ),
    "order_by_distance": _with(
        _NEAR, "SELECT uid, dist, row_number() OVER (ORDER BY dist, uid) - 1 AS position FROM near"
    ),
    "preview_neighbors": _with(_NEAR, f"SELECT uid, x, y, dist {_HITS} ORDER BY dist, uid LIMIT {PREVIEW_ROWS}"),
    "sample_point": _with([POINTS], f"SELECT uid, x, y FROM p ORDER BY {_fraction('uid', 'sample')}, uid LIMIT 1"),
    "unique_points": _with([POINTS], "SELECT min(uid) AS uid, x, y FROM p GROUP BY x, y"),
    "distinct_distance": _with(
        _NEAR,
        f"""SELECT min(uid) AS uid, arg_min(x, uid) AS x, arg_min(y, uid) AS y, dist
        FROM near WHERE dist <= {WIDE_RADIUS} GROUP BY dist""",
    ),
    # Scalar functions
    "pivot_point_key": _with(_CLOSEST, "SELECT uid, pivot_id || '_' || CAST(uid AS VARCHAR) AS pair FROM closest"),
    "point_pivot_distance": _with(
        _PAIRS, f"SELECT {_NAMED} AS uid, pivot_id, dist FROM pairs"
    ),
    # Streams
    "stream_decode": _with(
        _PIVOTS,
        """SELECT CAST(p.uid AS VARCHAR) AS uid, p.x AS x, p.y AS y, n AS stored
        FROM p, (SELECT CAST(count(*) AS INTEGER) AS n FROM pivots)""",
    ),
    "stream_range": _with(_NEAR, f"SELECT uid, x, y, dist {_HITS}"),
    "stream_range_messages": _with(_NEAR, f"SELECT CAST(uid AS VARCHAR) AS uid, x, y, dist {_HITS}"),
    "stream_certain_hits": _with(_CERTAIN, "SELECT CAST(uid AS VARCHAR) AS uid, x, y FROM certain"),
    "stream_match_count": _with(_NEAR, f"SELECT 'q41' AS query_id, count(*) AS matches {_HITS}"),
    "stream_stop_at_n": _with(
        [
            *_NEAR,
            f"hits AS (SELECT uid % {STOP_FILES} AS batch {_HITS})",
            f"""seen AS (
                SELECT b AS batch, (SELECT count(*) FROM hits WHERE hits.batch <= b) AS matches
                FROM unnest(range({STOP_FILES})) AS r(b)
            )""",
            f"""halt AS (
                SELECT coalesce(min(batch) FILTER (matches >= {STOP_AFTER}), {STOP_FILES - 1}) AS batch FROM seen
            )""",
        ],
        f"SELECT matches >= {STOP_AFTER} AS reached, batch, matches FROM seen JOIN halt USING (batch)",
    ),
    "stream_knn": _with(_NEAR, _NEAREST),
    "stream_metrics": _with(
        _NEAR,
        f"""SELECT uid % {STOP_FILES} AS batch, count(*) AS points, count(*) FILTER (dist <= {RADIUS} AND NOT is_query) AS matches
        FROM near GROUP BY batch""",
    ),
    "stream_window_hits": _with(_NEAR, f"SELECT date_trunc('hour', ts) AS start, count(*) AS matches {_HITS} GROUP BY 1").replace("FROM near", "FROM near JOIN events ON event_id = uid"),
    "stream_live_knn": _with(
        [
            "p AS (SELECT event_id AS uid, ts, CAST(user_id AS DOUBLE) AS x, value AS y FROM events)",
            f"asked AS (SELECT uid AS query_id, ts AS since, ts + INTERVAL {LIVE_DAYS} DAY AS until, x AS qx, y AS qy FROM p WHERE uid % {ASKED_EVERY} = 0)",
        ],
        f"""SELECT query_id, uid, x, y, {_APART} AS dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_APART}, uid) AS INTEGER) AS rank
        FROM p, asked WHERE ts >= since AND ts < until AND (x <> qx OR y <> qy) AND {_APART} <= {LIVE_RADIUS} QUALIFY rank <= {JOIN_NEIGHBOURS}""",
    ),
    "stream_timing": "SELECT count(*) AS rows FROM events",
}
