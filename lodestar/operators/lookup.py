"""Scans and key lookups over keyed cells ``(row, cf, cq, ts, value)``, and over any table with a key column.

All of them are plain comparisons on stored columns, so Parquet statistics and column pruning apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import local_frame

# Terms per bit mask.
MASK_BITS = 62


def scan_column(cells: DataFrame, family: str, qualifier: str | None = None) -> DataFrame:
    """All cells of one family, or of one family and qualifier."""
    chosen = F.col("cf") == family
    return cells.filter(chosen if qualifier is None else chosen & (F.col("cq") == qualifier))


def scan_count(cells: DataFrame, family: str) -> DataFrame:
    return scan_column(cells, family).agg(F.count("*").alias("cells"))


def scan_first(cells: DataFrame, family: str) -> DataFrame:
    """The first cell of a family in key order."""
    return scan_column(cells, family).orderBy("row", "cf", "cq").limit(1)


def lookup_row(cells: DataFrame, row: str, family: str, qualifier: str) -> DataFrame:
    return scan_column(cells, family, qualifier).filter(F.col("row") == row)


def lookup_row_family(cells: DataFrame, row: str, family: str) -> DataFrame:
    return scan_column(cells, family).filter(F.col("row") == row)


def lookup_prefix(cells: DataFrame, prefix: str, family: str, qualifier: str) -> DataFrame:
    return scan_column(cells, family, qualifier).filter(F.col("row").startswith(prefix))


def lookup_key_range(cells: DataFrame, start: tuple[str, str, str], stop: tuple[str, str, str]) -> DataFrame:
    """Cells whose key lies between two keys, both included, in key order.

    Keys compare column by column; the extra test on the row alone is what reaches the scan.
    """
    rows = F.col("row").between(start[0], stop[0])
    key = F.struct("row", "cf", "cq")
    low, high = (F.struct(*(F.lit(v).alias(n) for v, n in zip(k, ("row", "cf", "cq")))) for k in (start, stop))
    return cells.filter(rows & (key >= low) & (key <= high))


def exact_key_filter(cells: DataFrame, row: str, family: str, qualifier: str) -> DataFrame:
    """Cells with exactly this key."""
    return cells.filter((F.col("row") == row) & (F.col("cf") == family) & (F.col("cq") == qualifier))


def grep_key(cells: DataFrame, term: str) -> DataFrame:
    """Cells whose row contains the term."""
    return cells.filter(F.col("row").contains(term))


def batch_lookup(table: DataFrame, keys: list | DataFrame, key: str = "row", literal_keys: int = 1000) -> DataFrame:
    """Rows of many keys at once: up to ``literal_keys`` as a list in the plan, which reaches the scan; more as a
    semi join that Spark sizes. The rows are the same."""
    if isinstance(keys, DataFrame):
        return table.join(keys.select(key), key, "left_semi")
    if len(keys) <= literal_keys:
        return table.filter(F.col(key).isin(keys))
    frame = local_frame(table.sparkSession, [(k,) for k in keys], table.select(key).schema)
    return table.join(frame, key, "left_semi")


def postings(documents: DataFrame, id_column: str, text_column: str, terms: list[str] | None = None) -> DataFrame:
    """Inverted index ``(id, term)``: the distinct lower-case words of each whole text, or those among ``terms``."""
    words = F.split(F.lower(F.col(text_column)), r"[^\p{L}\p{N}]+")
    if terms is None:
        words = F.array_distinct(words)
    else:
        words = F.array_intersect(words, F.array(*map(F.lit, terms)))
    return (
        documents.select(F.col(id_column).alias("id"), F.explode(words).alias("term")).filter(F.col("term") != "")
    )


def term_intersect(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids that have all the terms. Each term is a bit, so tasks reduce an id to a mask before the shuffle."""
    terms = sorted(set(terms))
    if not terms:
        raise ValueError("term_intersect needs at least one term")
    blocks = [terms[i : i + MASK_BITS] for i in range(0, len(terms), MASK_BITS)]
    masks = []
    for i, block in enumerate(blocks):
        bit = F.lit(0).cast("bigint")
        for j, term in enumerate(block):
            bit = F.when(F.col("term") == term, F.lit(1 << j).cast("bigint")).otherwise(bit)
        masks.append(F.bit_or(bit).alias(f"_m{i}"))
    found = index.filter(F.col("term").isin(terms)).groupBy("id").agg(*masks)
    for i, block in enumerate(blocks):
        found = found.filter(F.col(f"_m{i}") == (1 << len(block)) - 1)
    return found.select("id")
