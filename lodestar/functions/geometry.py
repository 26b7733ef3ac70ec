"""Column expressions of planar geometry. All of them stay inside whole-stage code generation."""

from __future__ import annotations

import math
import sys
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import (
    BOX_SIDE,
    EPSILON,
    LOWER_LEFT,
    LOWER_RIGHT,
    UPPER_LEFT,
    UPPER_RIGHT,
)

LARGEST = sys.float_info.max


class Location(NamedTuple):
    """A query location: any coordinate pair, stored or not."""

    x: float
    y: float


def distance(ax, ay, bx, by) -> Column:
    """Euclidean distance. ``sqrt`` of squares, not ``hypot``: the two differ in the last bit."""
    dx, dy = _number(bx) - _number(ax), _number(by) - _number(ay)
    return F.sqrt(dx * dx + dy * dy)


def distance_to(q: Location, x: str = "x", y: str = "y") -> Column:
    return distance(q[0], q[1], F.col(x), F.col(y))


def plain_distance(a, b) -> float:
    """``distance`` for two driver-side locations, bit for bit."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    return math.sqrt(dx * dx + dy * dy)


def usable(x: str = "x", y: str = "y") -> Column:
    """Both coordinates are finite numbers.

    Spark orders NaN above every number, so two range tests also exclude NaN, infinities and nulls, and
    unlike ``isnan`` they reach the Parquet scan.
    """
    return F.col(x).between(-LARGEST, LARGEST) & F.col(y).between(-LARGEST, LARGEST)


def spread_bits(bits: Column) -> Column:
    """Put a zero bit before every bit."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
    return bits


def cross(ax, ay, bx, by, px, py) -> Column:
    """Positive when p lies left of the line a to b, negative when right of it."""
    ax, ay, bx, by, px, py = map(_number, (ax, ay, bx, by, px, py))
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def cross_text(a: Location, b: Location) -> str:
    """``cross`` of a fixed line and the columns x and y as SQL text.

    A filter over many lines is one parse this way, instead of a call to the JVM for each operation.
    """
    dx, dy = b[0] - a[0], b[1] - a[1]
    return f"{number_text(dx)} * (y - {number_text(a[1])}) - {number_text(dy)} * (x - {number_text(a[0])})"


def number_text(value: float) -> str:
    """A double as SQL text, exact to the last bit."""
    return f"({float(value)!r}D)"


def snap_zero(value) -> Column:
    """Values within EPSILON of zero become zero."""
    value = _number(value)
    return F.when(F.abs(value) <= EPSILON, 0.0).otherwise(value)


def same_place(q: Location, x: str = "x", y: str = "y") -> Column:
    """Exactly equal in both coordinates."""
    return (F.col(x) == F.lit(float(q[0]))) & (F.col(y) == F.lit(float(q[1])))


def inside_window(q: Location, side: float = BOX_SIDE, x: str = "x", y: str = "y") -> Column:
    """Strictly inside the square of the given side around q; plain comparisons, so they are pushed down."""
    half = side / 2.0
    return (
        (F.col(x) > F.lit(q[0] - half))
        & (F.col(x) < F.lit(q[0] + half))
        & (F.col(y) > F.lit(q[1] - half))
        & (F.col(y) < F.lit(q[1] + half))
    )


def quadrant_of(x, y, centre: Location) -> Column:
    """Quadrant around ``centre``; points on an axis go to the first quadrant that takes them."""
    x, y = _number(x), _number(y)
    left, right = x <= F.lit(centre[0]), x >= F.lit(centre[0])
    upper, lower = y >= F.lit(centre[1]), y <= F.lit(centre[1])
    return (
        F.when(left & upper, UPPER_LEFT)
        .when(right & upper, UPPER_RIGHT)
        .when(right & lower, LOWER_RIGHT)
        .otherwise(LOWER_LEFT)
    )


def plain_quadrant(q: Location, centre: Location) -> str:
    """``quadrant_of`` for one driver-side location."""
    if q[1] >= centre[1] and q[0] <= centre[0]:
        return UPPER_LEFT
    if q[0] >= centre[0]:
        return UPPER_RIGHT if q[1] >= centre[1] else LOWER_RIGHT
    return LOWER_LEFT


def derive_range(k, density) -> Column:
    """Radius of the disc that holds k points at the given density; null when the density is zero."""
    return F.sqrt(F.try_divide(_number(k), _number(density) * F.lit(math.pi)))


def plain_derive_range(k: int, density: float | None) -> float:
    """``derive_range`` on the driver; unbounded when the density is zero or unknown."""
    if not density:
        return math.inf
    return math.sqrt(k / (density * math.pi))


def _number(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value))
