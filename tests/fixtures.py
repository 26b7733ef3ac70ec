"""Small point sets and brute-force answers."""

from __future__ import annotations

import math
import random

POINT_SCHEMA = "uid bigint, x double, y double"


def frame(spark, places, partitions: int = 3):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(rows, POINT_SCHEMA).repartition(partitions)


def scattered(n: int, seed: int, grid: int | None = None):
    draw = random.Random(seed)
    if grid:
        return [(draw.randrange(grid), draw.randrange(grid)) for _ in range(n)]
    return [(draw.gauss(0, 10), draw.uniform(-50, 50)) for _ in range(n)]


def ring(n: int, radius: float = 1000.0):
    return [(radius * math.cos(2 * math.pi * i / n), radius * math.sin(2 * math.pi * i / n)) for i in range(n)]


def hot_spot(n: int, seed: int):
    """A third of the points at the outermost corner, a third at one inner place, the rest scattered."""
    third = n // 3
    return [(60.0, 60.0)] * third + [(1.0, 2.0)] * third + scattered(n - 2 * third, seed)


def gap(a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    return math.sqrt(dx * dx + dy * dy)


def brute_diameter(places) -> float:
    return max((gap(a, b) for a in places for b in places), default=0.0)


def brute_hull(places):
    """Vertices of the hull by the monotone chain."""
    places = sorted(set((float(x), float(y)) for x, y in places))
    if len(places) <= 2:
        return set(places)

    def half(sequence):
        chain = []
        for p in sequence:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    def turn(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    return set(half(places)) | set(half(places[::-1]))


def brute_pivots(places, alpha: float = 0.37):
    spacing = alpha * brute_diameter(places)
    chosen = [0]
    for i in range(1, len(places)):
        if spacing and all(gap(places[i], places[j]) >= spacing for j in chosen):
            chosen.append(i)
    return chosen


def brute_range(places, q, r):
    found = [(gap(p, q), i) for i, p in enumerate(places) if tuple(p) != tuple(q) and gap(p, q) <= r]
    return sorted(found)
