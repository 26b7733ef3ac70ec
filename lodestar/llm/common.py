"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[ \t-\r]+"

ROW = "row"

#: Ranges of a sort beyond which they grow instead: their bounds are found by the driver.
MOST_RANGES = 100_000


def with_row(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """The input row as one struct ``row`` (all of its columns, or those to keep), and the given columns beside it.

    Whatever the input's other columns are called, they cannot clash with what an operator adds.
    """
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]
    return df.select(F.struct(*kept).alias(ROW), *[c.alias(n) for n, c in columns.items()])


def field(name: str) -> Column:
    """A column of the input row that ``with_row`` packed."""
    return F.col(ROW)[name]


def unpacked(df: DataFrame) -> DataFrame:
    """The input rows again, with their own columns only."""
    return df.select(f"{ROW}.*")


def words_of(text: Column) -> Column:
    """All words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def ranges_of(stored: DataFrame, size: int) -> int:
    """How many ranges of about ``size`` bytes a table makes that was written and read back."""
    plan = stored._jdf.queryExecution().optimizedPlan()
    return min(MOST_RANGES, int(str(plan.stats().sizeInBytes())) // size + 1)
