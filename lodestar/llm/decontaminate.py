"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so a question with other parameters has the windows of the
original. Windows of the items go into a table and into a bitmap of fixed size; documents are read once, whole, and
only windows whose bit is set leave their task. A hash join with the item windows decides which are real. Where a
document follows an item, the values in its slots must be consistent: one value of the item, one value of the document
along the whole stretch. An item is found in a document when matching windows cover enough of its words, or
when one run of words without a gap is long enough, whatever its share of the item.

Windows of the plain words are looked up beside the template's, for texts whose names only look so by their place.

Defined results: null and empty texts match nothing; items of fewer than ``least`` words match nothing, since chance
would; null item ids are not searched for; repeated rows and repeated items give their rows once per id; an
empty table on either side gives no rows; other columns pass through in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import with_row
from lodestar.session import written

#: Numbers, words, and what ends a sentence.
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")

# Units of measure, which count as such after a number.
UNITS = frozenset(
    "km m cm mm mile miles meter meters metre metres kilometer kilometers foot feet inch inches kg g mg gram grams "
    "kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars "
    "euro euros cent cents usd eur percent degree degrees mph kmh".split()
)

#: Low bits of a token's code; the others are a hash of the word in lower case.
NAME_LIKE, ENDING, NUMBER, UNIT = 1, 2, 4, 8
FLAGS = 15

NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = (np.uint64(16 * k) for k in (1, 2, 3))
FACTOR = np.uint64(0x9E3779B97F4A7C15)

#: Bits of the bitmap, a power of two: 2 MB, whatever the benchmark holds. More items mean more windows to join, not fewer found.
BITMAP_BITS = 1 << 24
BITMAP_BUCKET = 1 << 15


@dataclass(frozen=True)
class Matching:
    """Words per window, the shortest item, literal words a template window needs, the share of an item's
    words that matching windows must cover, and the words in a row that do whatever their share."""

    window: int = 6
    least: int = 4
    literals: int = 3
    covered: float = 0.5
    run: int = 13


class _Codes(dict):
    """Code of each token, kept while it is worth it."""

    LIMIT = 500_000

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first in ".!?:\n":
            code = ENDING
        else:
            code = xxhash.xxh64_intdigest(token.lower()) & ~FLAGS
            if first.isdigit():
                code |= NUMBER
            elif token.lower() in UNITS:
                code |= UNIT
            elif first.isupper() and not token[1:2].isupper():
                code |= NAME_LIKE
        if len(self) < self.LIMIT:
            self[token] = code
        return code


@lru_cache(maxsize=1)
def _codes() -> _Codes:
    return _Codes()


def canonical(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Plain codes of a text's words, and the same with placeholders in place of numbers, names and units.

    A name is a capitalised word that does not begin a sentence; a unit is a word of measure after a number.
    """
    tokens = TOKEN.findall(text)
    codes = np.fromiter(map(_codes().__getitem__, tokens), np.uint64, len(tokens))
    flags = codes & np.uint64(FLAGS)
    before = np.concatenate((np.array([ENDING], np.uint64), flags[:-1]))
    slots = codes & ~np.uint64(FLAGS)
    plain = slots.copy()
    slots[flags == NUMBER] = NUMBER_SLOT
    slots[(flags == NAME_LIKE) & (before != ENDING)] = NAME_SLOT
    slots[(flags == UNIT) & (before == NUMBER)] = UNIT_SLOT
    words = flags != ENDING
    return plain[words], slots[words]


def _hashes(codes: np.ndarray, window: int) -> np.ndarray:
    found = np.zeros(max(0, len(codes) - window + 1), np.uint64)
    for k in range(window):
        found = (found + codes[k : k + len(found)]) * FACTOR
        found ^= found >> np.uint64(29)
    return found


def windows(text: str, lengths: tuple[int, ...], literals: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """Per length and kind: the length, places, hashes, slots' values (of template windows) and whether each is a slot."""
    plain, slots = canonical(text)
    is_slot = slots <= UNIT_SLOT
    for length in lengths:
        if len(plain) < length:
            continue
        salt = np.uint64(length)
        yield length, np.arange(len(plain) - length + 1), _hashes(plain, length) + salt, None, is_slot
        filled = np.convolve(is_slot, np.ones(length, np.int64), "valid") if is_slot.any() else np.zeros(0, np.int64)
        at = np.flatnonzero((filled > 0) & (length - filled >= min(literals, length)))
        if len(at):
            yield length, at, _hashes(slots, length)[at] + salt, plain, is_slot


def _rows(text: str, lengths: tuple[int, ...], literals: int, bitmap: np.ndarray | None = None) -> list[dict]:
    out = []
    for length, at, hashes, plain, is_slot in windows(text, lengths, literals):
        if bitmap is not None:
            bit = hashes & np.uint64(BITMAP_BITS - 1)
            hit = np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            at, hashes = at[hit], hashes[hit]
        for place, value in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
            own = slice(place, place + length)
            values = [] if plain is None else plain[own][is_slot[own]].view(np.int64).tolist()
            out.append({"place": place, "hash": value, "size": length, "values": values})
    return out


WINDOWS = "array<struct<place:int,hash:long,size:int,values:array<long>>>"
ARROW_WINDOWS = pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64()), ("size", pa.int32()), ("values", pa.list_(pa.int64()))]))


def item_windows(items: DataFrame, matching: Matching, item_id: str, text: str) -> DataFrame:
    """``(item_id, words, place, hash, size, values)``; an item shorter than a window is one window of its own."""

    @F.arrow_udf(f"struct<words:int,windows:{WINDOWS}>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = len(canonical(t or "")[0])
            lengths = (min(words, matching.window),) if words >= matching.least else ()
            out.append({"words": words, "windows": _rows(t or "", lengths, matching.literals)})
        return pa.array(out, pa.struct([("words", pa.int32()), ("windows", ARROW_WINDOWS)]))

    named = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), cut(text).alias("cut"))
    rows = named.select("item_id", F.col("cut.words").alias("words"), F.explode("cut.windows").alias("w"))
    return rows.select("item_id", "words", "w.*").distinct()


def bitmap_of(found: DataFrame) -> np.ndarray:
    """The bitmap of all hashes, put together by Spark in pieces of 4 kB, at most 512 of them."""
    bit = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))
    parts = found.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("n"))
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    step = BITMAP_BUCKET // 8
    for row in parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect():
        bitmap[(row["n"] - 1) * step : row["n"] * step] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bitmap


def found_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, matching: Matching | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents as ``(at, row)``, and the items found as ``(at, item_id, covered, words, changed)``: words of the
    item that matching windows cover, all its words, and whether its parameters are changed."""
    matching = matching or Matching()
    known = written(item_windows(items, matching, item_id, item_text), "items")
    sizes = tuple(sorted(r["size"] for r in known.select("size").distinct().collect()))
    # Packed: a shared variable instead of a part of every task.
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(known))
    literals = matching.literals

    @F.arrow_udf(WINDOWS)
    def candidates(texts: pa.Array) -> pa.Array:
        return pa.array([_rows(t or "", sizes, literals, bitmap.value) for t in texts.to_pylist()], ARROW_WINDOWS)

    marked = with_row(docs, keep, text=F.col(text)).select("row", candidates("text").alias("windows"), F.monotonically_increasing_id().alias("at"))
    marked = written(marked, "windows")
    seen = marked.select("at", F.explode("windows").alias("w")).select("at", "w.*").withColumnRenamed("values", "own")
    pairs = seen.withColumnRenamed("place", "here").join(known, ["hash", "size"])
    pairs = written(pairs.select("at", "item_id", "words", "place", "size", (F.col("here") - F.col("place")).alias("shift"), "values", "own"), "pairs")
    stretch = ["at", "item_id", "shift"]
    slots = pairs.filter(F.size("values") > 0).select(*stretch, F.explode(F.arrays_zip("values", "own")).alias("slot"))
    per_value = slots.groupBy(*stretch, F.col("slot.values").alias("value")).agg(F.min("slot.own").alias("least"), F.max("slot.own").alias("most"))
    judged = per_value.groupBy(*stretch).agg(
        F.max((F.col("least") != F.col("most")).cast("int")).alias("broken"),
        F.max((F.col("least") != F.col("value")).cast("int")).alias("changed"),
    )
    # A broken stretch keeps its plain windows, which hold no slot.
    sound = pairs.join(judged, stretch, "left").filter((F.size("values") == 0) | (F.coalesce("broken", F.lit(0)) == 0))
    # Windows of one shift that overlap or touch are one run.
    along = Window.partitionBy(*stretch).orderBy("place", "size")
    end = F.col("place") + F.col("size")
    ends = sound.withColumn("reached", F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    begun = F.when(F.col("reached").isNull() | (F.col("place") > F.col("reached")), F.col("place"))
    runs = ends.withColumn("run", end - F.last(begun, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    places = runs.groupBy("at", "item_id", "place").agg(
        F.max("words").alias("words"), F.max("size").alias("size"), F.max("run").alias("run"), F.max(F.coalesce("changed", F.lit(0))).alias("changed")
    )
    last = F.lag("place").over(Window.partitionBy("at", "item_id").orderBy("place"))
    fresh = places.withColumn("fresh", F.least("size", F.coalesce(F.col("place") - last, F.col("size"))))
    found = fresh.groupBy("at", "item_id").agg(F.sum("fresh").alias("covered"), F.max("words").alias("words"), (F.max("changed") == 1).alias("changed"), F.max("run").alias("run"))
    enough = (F.col("covered") >= matching.covered * F.col("words")) | (F.col("run") >= matching.run)
    return marked.select("at", "row"), found.filter(enough).drop("run")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    rows, found = found_items(docs, items, **options)
    return rows.join(found.select("at").distinct(), "at", "left_anti").select("row.*")
