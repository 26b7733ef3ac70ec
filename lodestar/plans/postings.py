"""Stored inverted index: which rows have all of some terms, without reading the rows.

Rows are numbered. A posting is a term, a block of 2 ** 15 numbers, and the bits of the rows in it that have the term, as
words of 64 bits of which only those that are not zero are kept. Postings stand in order of term and block, so a search reads the
row groups of its terms only; it ANDs the words and counts the terms that met in each. A term that every row has is one
posting per block, spread like any other. Rows are appended in segments that begin with a block of their own, and a new
version of the list of segments makes them visible.

The same postings over the character n-grams of a key find substrings: n-grams select candidates, the key itself decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.ordering import numbered
from lodestar.sources.versions import publish_version, read_version

#: Rows of a block, and of a word.
BLOCK_BITS, WORD_BITS = 15, 6

#: Longest n-gram of a key. Shorter terms are looked up as they are, so all shorter n-grams are stored too.
GRAM = 3

POSTINGS = "term string, block bigint, words array<struct<at: int, bits: bigint>>"


def words_of(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(F.array_distinct(words), "")


def grams_of(key: Column, size: int = GRAM) -> Column:
    """Distinct n-grams of a key, of all sizes up to ``size``."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(key) - (n - 1))
        own = F.transform(starts, lambda at: F.substring(key, at, F.lit(n)))
        return F.when(F.length(key) >= n, own).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(1, size + 1))))


def term_grams(term: str, size: int = GRAM) -> list[str]:
    """The n-grams that every key with the term must have."""
    return sorted({term[i : i + size] for i in range(max(1, len(term) - size + 1))})


@dataclass(frozen=True)
class PostingIndex:
    """An index as of one version."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[dict, ...]
    id_type: str

    @property
    def postings(self) -> DataFrame:
        """``(term, block, words)`` of all segments."""
        return self.spark.read.schema(POSTINGS).parquet(*[f"{self.path}/{s['name']}/postings" for s in self.segments])

    @property
    def ids(self) -> DataFrame:
        """``(number, id)`` of all rows."""
        return self.spark.read.schema(f"number bigint, id {self.id_type}").parquet(*[f"{self.path}/{s['name']}/ids" for s in self.segments])

    def having_all(self, terms: Sequence[str]) -> DataFrame:
        """``id`` of the rows that have all the terms; an id that was added twice is there once."""
        wanted = sorted(set(terms))
        if not wanted:
            raise ValueError("at least one term is needed")
        words = self.postings.filter(F.col("term").isin(wanted)).select("block", F.inline("words"))
        met = words.groupBy("block", "at").agg(F.count("*").alias("n"), F.bit_and("bits").alias("bits"))
        met = met.filter((F.col("n") == len(wanted)) & (F.col("bits") != 0))
        bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1))
        number = F.shiftleft("block", BLOCK_BITS) + F.shiftleft("at", WORD_BITS) + F.col("bit")
        found = met.select("block", "at", bit.alias("bit")).select(number.alias("number"))
        return self.ids.join(found, "number", "left_semi").select("id").distinct()

    def containing(self, term: str) -> DataFrame:
        """``id`` of the keys that contain the term. Only for an index over n-grams."""
        if not term:
            return self.ids.select("id").distinct()
        return self.having_all(term_grams(term)).filter(F.col("id").contains(term))

    def files_read(self, terms: Sequence[str]) -> DataFrame:
        """``(files, files_with_terms, postings)``: files of postings, those that hold the terms, and rows read of them."""
        rows = self.postings.select("term", F.col("_metadata.file_path").alias("file"))
        asked = F.col("term").isin(sorted(set(terms)))
        return rows.agg(
            F.countDistinct("file").alias("files"), F.countDistinct(F.when(asked, F.col("file"))).alias("files_with_terms"), F.count(F.when(asked, 1)).alias("postings")
        )

    def append(self, rows: DataFrame, files: int | None = None) -> PostingIndex:
        """Add rows ``(id, terms)``, and the index with them. Whoever has opened it before goes on without them."""
        segment = _write_segment(rows, self.path, sum(s["blocks"] for s in self.segments), files)
        return _published(self.spark, self.path, self.version, [*self.segments, segment], self.id_type)


def _published(spark: SparkSession, path: str, after: int | None, segments: list[dict], id_type: str) -> PostingIndex:
    version = publish_version(spark, path, after, {"segments": segments, "id_type": id_type})
    return PostingIndex(spark, path, version, tuple(segments), id_type)


def _write_segment(rows: DataFrame, path: str, first_block: int, files: int | None) -> dict:
    spark, name = rows.sparkSession, f"segment-{uuid.uuid4().hex}"
    placed = numbered(rows.select("id", "terms"), "number")
    placed = placed.withColumn("number", F.col("number") + (first_block << BLOCK_BITS))
    placed.select("number", "id").sortWithinPartitions("number").write.parquet(f"{path}/{name}/ids")
    number = F.col("number")
    single = placed.select(
        F.explode("terms").alias("term"), F.shiftright(number, BLOCK_BITS).alias("block"),
        F.shiftright(number, WORD_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS - WORD_BITS) - 1)).cast("int").alias("at"),
        F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")).alias("bits"),
    )
    # One shuffle serves both aggregates and the order of the files.
    keys = ["term", "block"]
    spread = single.repartitionByRange(files, *keys) if files else single.repartitionByRange(*keys)
    words = spread.groupBy(*keys, "at").agg(F.bit_or("bits").alias("bits"))
    words = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("words"))
    words.sortWithinPartitions(*keys).write.parquet(f"{path}/{name}/postings")
    last = spark.read.parquet(f"{path}/{name}/ids").agg(F.max("number")).first()[0]
    return {"name": name, "blocks": 0 if last is None else (last >> BLOCK_BITS) + 1 - first_block}


def build_postings(rows: DataFrame, path: str, files: int | None = None) -> PostingIndex:
    """An index over rows ``(id, terms)``: an identifier and an array of distinct terms. ``files`` is the number of
    ranges of terms; without it, the session's number of shuffle partitions."""
    segment = _write_segment(rows, path, 0, files)
    return _published(rows.sparkSession, path, None, [segment], rows.schema["id"].dataType.simpleString())


def open_postings(spark: SparkSession, path: str) -> PostingIndex:
    """The last version of a stored index."""
    version, content = read_version(spark, path)
    return PostingIndex(spark, path, version, tuple(content["segments"]), content["id_type"])


def text_rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents as rows of an index over their words."""
    return documents.select(F.col(id_column).alias("id"), words_of(F.col(text_column)).alias("terms"))


def key_rows(table: DataFrame, key: str = "row") -> DataFrame:
    """The keys of a table as rows of an index over their n-grams."""
    keys = table.filter(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    return keys.withColumn("terms", grams_of(F.col("id")))


def rows_with_all(index: PostingIndex, sets: list[list[str]]) -> DataFrame:
    """``(terms, id)``: for each set of terms, joined by a space, the rows that have all of them."""
    each = [index.having_all(terms).select(F.lit(" ".join(terms)).alias("terms"), "id") for terms in sets]
    return reduce(DataFrame.unionByName, each)


def grep_stored(cells: DataFrame, index: PostingIndex, term: str) -> DataFrame:
    """Cells whose row contains the term, by the index over the rows."""
    return cells.join(index.containing(term).withColumnRenamed("id", "row"), "row", "left_semi")
