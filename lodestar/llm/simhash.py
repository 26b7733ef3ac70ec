"""SimHash near-duplicates: fingerprints of four-word shingles, linked at a few differing bits.

Equal fingerprints collapse into a class first, so copies cost nothing later. The bits are cut into ``radius +
matching`` blocks; two fingerprints within the radius agree on at least ``matching`` of them, so they meet in a bucket
of one of the block combinations. Buckets are compared bit-sliced: plane b holds bit b of 64 fingerprints in a word,
all distances between lane i and lane i + d are counted at once by carry-save adders, and words whose lanes have all
exceeded the radius are dropped on the way. A bucket beyond ``UNIT`` classes is cut into blocks and compared
block pair by block pair, each in a task of its own: no pair is lost and no task grows. Each unit emits only
links that join what it has not joined yet, and the components come from star contraction.

Defined results: a null or empty text has fingerprint zero and links like any other; rows with a null id take part in
no link and get a null component; repeated ids share one; an empty table gives no rows; other columns pass
through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import with_row
from lodestar.llm.components import components
from lodestar.session import written

SHINGLE = 4
SEED = 42
BITS = 64

#: Classes compared in one unit of work. Larger buckets are cut; the links are the same for every value.
UNIT = 4096

#: Shingles whose bits are counted at once.
STEP = 1 << 18


def fingerprint_of(text: bytes) -> int:
    """SimHash of a text: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()  # on bytes: A-Z, and the six white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    last = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], last[:-1] + 1))
    ends, count = last[SHINGLE - 1 :].tolist() or [len(joined)], np.zeros(BITS, np.int64)
    starts, digest = first[: len(ends)].tolist(), xxhash.xxh64_intdigest
    for at in range(0, len(ends), STEP):
        part = zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(ends), bitorder="little").view("<i8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` and its 64-bit ``fingerprint``."""
    df = with_row(docs, text=F.col(text))
    return df.select("row", _fingerprints(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def _buckets(fingerprint: Column, radius: int, matching: int) -> Column:
    """One bucket number for each combination of ``matching`` blocks."""
    blocks = radius + matching
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(k), *[part[i] for i in chosen]) for k, chosen in enumerate(combinations(range(blocks), matching))])


def _planes(fingerprints: np.ndarray) -> np.ndarray:
    """Bit planes: bit i % 64 of word i // 64 in row b is bit b of fingerprint i."""
    lanes = np.zeros(-(-len(fingerprints) // BITS) * BITS, "<u8")
    lanes[: len(fingerprints)] = fingerprints
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _shifted(planes: np.ndarray, by: int, words: np.ndarray) -> np.ndarray:
    """The chosen words of the planes moved down by some lanes. The planes end in a spare zero word."""
    far, near = by // BITS, by % BITS
    last = planes.shape[1] - 1
    low = planes[:, np.minimum(words + far, last)]
    if not near:
        return low
    high = planes[:, np.minimum(words + far + 1, last)]
    return (low >> np.uint64(near)) | (high << np.uint64(BITS - near))


def near_pairs(fingerprints: np.ndarray, run_end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(i, i + d)`` within the radius, for one distance d in the order after the other.

    ``run_end[i]`` is the end of the run of rows that i is compared with.
    """
    n, width = len(fingerprints), max(1, radius.bit_length())
    planes = np.pad(_planes(fingerprints), ((0, 0), (0, 1)))
    reach = run_end - np.arange(n)
    start = (1 << width) - 1 - radius  # the counters overflow at radius + 1
    for d in range(1, int(reach.max(initial=0))):
        compared = np.zeros(planes.shape[1] * BITS, bool)
        compared[:n] = reach > d
        wanted = np.packbits(compared, bitorder="little").view("<u8")
        words = np.flatnonzero(wanted)
        over = ~wanted[words]
        differ = planes[:, words] ^ _shifted(planes, d, words)
        counter = [np.full(len(words), ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(width)]
        for b in range(0, BITS, 2):
            x, y = differ[b], differ[b + 1]
            half = counter[0] ^ x
            carry, counter[0] = (counter[0] & x) | (half & y), half ^ y
            for k in range(1, width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if b % 8 == 6:
                alive = ~over != 0
                if not alive.any():
                    break
                if 2 * np.count_nonzero(alive) < len(alive):
                    words, over, differ = words[alive], over[alive], differ[:, alive]
                    counter = [c[alive] for c in counter]
        else:
            lanes = np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, BITS)
            word, bit = np.nonzero(lanes)
            if len(word):
                i = words[word] * BITS + bit
                yield i, i + d


def _joining(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[list[int], list[int]]:
    """The pairs that join two parts of the n rows that earlier pairs have not joined."""
    root = np.arange(n)
    left: list[int] = []
    right: list[int] = []
    for i, j in pairs:
        fresh = np.flatnonzero(root[i] != root[j])
        for a, b in zip(i[fresh].tolist(), j[fresh].tolist(), strict=True):
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
        while len(fresh) and not np.array_equal(root, flat := root[root]):
            root = flat
    return left, right


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within the units of a partition, which is sorted by unit; an unfinished unit waits for the next batch."""

    def linked(unit: np.ndarray, fingerprint: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        size = np.diff(np.concatenate((starts, [len(unit)])))
        several = np.repeat(size > 1, size)  # most units hold one row
        fingerprint, ids, size = fingerprint[several], ids[several], size[size > 1]
        run_end = np.repeat(np.cumsum(size), size)
        left, right = _joining(near_pairs(fingerprint.view("<u8"), run_end, radius), len(ids))
        return pa.record_batch({"u": ids[left], "v": ids[right]}, pa.schema({"u": pa.int64(), "v": pa.int64()}))

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if whole:
            yield linked(*[h[:whole] for h in held])
            held = [h[whole:] for h in held]
    if len(held[0]):
        yield linked(*held)


def linked_classes(fingerprints: DataFrame, radius: int = 4, matching: int = 2, unit: int = UNIT) -> DataFrame:
    """``(fingerprint, rep, component)`` per distinct fingerprint of ``(id, fingerprint)`` rows: its smallest id,
    and the smallest id that links of at most ``radius`` bits reach."""
    classes = fingerprints.groupBy("fingerprint").agg(F.min("id").alias("rep"))
    classes = written(classes, "classes")
    keyed = classes.filter("rep IS NOT NULL").select(
        F.explode(_buckets(F.col("fingerprint"), radius, matching)).alias("bucket"), "fingerprint", "rep"
    )
    # Written, so that Spark joins by its true size.
    hot = written(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > unit), "hot")
    cut = F.ceil(F.col("n") / unit).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint"), cut).cast("int")
    with_each = F.transform(
        F.sequence(F.lit(0), cut - 1), lambda other: F.xxhash64("bucket", F.least(mine, other), F.greatest(mine, other))
    )
    units = keyed.join(hot, "bucket", "left").select(
        F.explode(F.when(F.col("n").isNull(), F.array("bucket")).otherwise(with_each)).alias("unit"), "fingerprint", "rep"
    )
    links = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda it: _links(it, radius), "u long, v long")
    found = components(links).withColumnRenamed("u", "rep")
    return classes.join(found, "rep", "left").select("fingerprint", "rep", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """``row``, ``fingerprint`` and ``component``, the smallest id reachable; null where the id is."""
    marked, classes = _classified(docs, doc_id, text, radius)
    component = F.when(F.col("id").isNotNull(), F.col("component"))
    return marked.join(classes, "fingerprint").select("row", "fingerprint", component.alias("component"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row of each component as it came, that of its smallest id, and all rows without an id.

    The rows meet the list of those to keep by their place, which is unique, so copies of one text never meet.
    """
    marked, classes = _classified(docs, doc_id, text, radius)
    # Of repeated ids one row stays.
    chosen = marked.filter("id IS NOT NULL").groupBy("fingerprint").agg(F.min_by("at", "id").alias("at"))
    first = classes.filter("rep = component").join(chosen, "fingerprint").select("at")
    alone = marked.filter("id IS NULL").select("at")
    return marked.select("at", "row").join(first.unionByName(alone), "at", "left_semi").select("row")


def _classified(docs: DataFrame, doc_id: str, text: str, radius: int) -> tuple[DataFrame, DataFrame]:
    marked = fingerprinted(docs, text).select("*", F.monotonically_increasing_id().alias("at"))
    marked = written(marked.select("*", F.col("row")[doc_id].cast("long").alias("id")), "fingerprints")
    return marked, linked_classes(marked.select("id", "fingerprint"), radius)
