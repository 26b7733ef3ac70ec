"""Identifiers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import PIVOT_PREFIX, POINT_PREFIX


def point_uid(number: Column | str) -> Column:
    """``point_<n>``"""
    return F.concat(F.lit(POINT_PREFIX), number)


def pivot_id(ordinal: int) -> str:
    """``pivot_<n>``"""
    return f"{PIVOT_PREFIX}{ordinal}"


def hashed_uid(uid: Column | str) -> Column:
    """A key that spreads evenly: the hex SHA-256 of the identifier."""
    return F.sha2(F.col(uid) if isinstance(uid, str) else uid, 256)


def pair_key(pivot: Column | str, uid: Column | str) -> Column:
    """``<pivot>_<point>``, the readable key of one stored distance."""
    return F.concat_ws("_", pivot, uid)
