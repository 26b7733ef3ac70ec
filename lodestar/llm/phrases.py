"""Phrase collocations: exact counts of all n-grams that are frequent, in counting quotient filters.

Texts are cut into blocks of about ``BLOCK_WORDS`` words of one language; each block numbers its own words and stands
as an array of numbers, with zero between pieces. Words are counted first, by ranges of a checksum. From then on a block works level by level: an n-gram
can only be frequent if its first and last n - 1 words are, so a block keeps the runs in which everything so far is frequent
and drops the rest. A block sends its n-grams as a counting quotient filter (``quotient.py``), cut by ranges of the
quotient; the filters of one range are merged in one task, whatever the blocks and languages, and each block is told by one
bit per entry which of them are frequent. So no dictionary is broadcast, and a block only ever hears of what it holds itself.
Keys are permuted before they are cut, so ranges are equally full; a phrase that is in every text is one entry per
block. The number of ranges follows from the number of words.

Defined results: a null text is empty; a null language is ``und``; documents without a word give nothing; repeated
rows count again; no rows give no phrases; other columns are not used.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.quotient import CountingQuotientFilter, Packing, merged
from lodestar.session import written

UNKNOWN = "und"

#: Pieces end at these characters; words are separated by space and tab.
ENDS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(ENDS, b"." * len(ENDS))

#: Words in a block, words that all blocks of a task hold together, and entries of all blocks for one task that merges
#: them. They change time and memory, never the result.
BLOCK_WORDS, HELD_WORDS, RANGE_WORDS = 1 << 21, 1 << 22, 1 << 22

#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20

#: ``marks`` are checksums of the words, in order; ``ranks`` the block's own numbers of them.
BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), *((c, pa.binary()) for c in ("marks", "ranks", "counts", "ids")), ("entries", pa.int64())])
BLOCKS_DDL = "block long, lang string, words array<string>, marks binary, ranks binary, counts binary, ids binary, entries long"
SHARES = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("part", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.binary())])
SHARES_DDL = "block long, lang string, part int, words array<string>, counts binary"
WORDS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("id", pa.int64())])
WORDS_DDL = "block long, part int, ids binary, lang string, word string, f long, id long"

#: A block's runs stand in the part OWN, its n-grams in the parts from 0.
OWN = -1
LEVEL = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
LEVEL_DDL = "block long, part int, data binary"

MERGED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("bits", pa.binary()), ("ids", pa.list_(pa.int64())), ("f", pa.int64())])
MERGED_DDL = "block long, part int, bits binary, ids array<long>, f long"


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes, as many as the largest needs, compressed."""
    size = -(-max(1, int(numbers.max(initial=0)).bit_length()) // 8)
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T)
    return bytes([size]) + len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _wide(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = planes.T
    return out.reshape(-1).view("<i8")


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in slices that end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end] not in b" .":
            end += 1
        yield text[at:end]
        at = end


class _Buffer:
    """Words of one language that wait for their block to be full. Number 0 is the end of a piece."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[b"."] = 0
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.replace(b".", b" . ").split()
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def end(self) -> None:
        self.ids.append(np.zeros(1, np.uint32))

    def row(self, block: int, lang: str) -> dict | None:
        ids = np.concatenate(self.ids)
        ids = ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))]
        if len(self.numbers) == 1:
            return None
        # Frequent words have small numbers.
        counts = np.bincount(ids, minlength=len(self.numbers))
        order = np.argsort(-counts[1:], kind="stable") + 1
        ranks = np.zeros(len(counts), np.int64)
        ranks[order] = np.arange(1, len(counts))
        words = list(self.numbers)[1:]
        marks = np.fromiter(map(crc32, words), np.int64, len(words))
        order = np.argsort(marks, kind="stable")
        words = pa.array(words, pa.binary()).cast(pa.string()).take(order).to_pylist()
        packed = {"marks": _narrow(marks[order]), "ranks": _narrow(ranks[1:][order]), "counts": _narrow(counts[1:][order]), "ids": _narrow(ranks[ids])}
        return {"block": block, "lang": lang, "words": words, "entries": len(words)} | packed


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 32, 0
    waiting: dict[str, _Buffer] = {}
    held = 0

    def rows(langs: list[str]) -> Iterator[pa.RecordBatch]:
        nonlocal made, held
        for lang in langs:
            buffer = waiting.pop(lang)
            held -= buffer.size
            row = buffer.row(base + made, lang)
            made += 1
            if row:
                yield pa.RecordBatch.from_pylist([row], BLOCKS)

    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            buffer = waiting.setdefault(lang, _Buffer())
            before = buffer.size
            plain = text.as_py().lower().translate(PLAIN).replace(b"\t", b" ")
            for part in _slices(plain):
                buffer.add(part)
            buffer.end()
            held += buffer.size - before
            if buffer.size >= BLOCK_WORDS:
                yield from rows([lang])
            elif held >= HELD_WORDS:
                yield from rows(list(waiting))
    yield from rows(list(waiting))


def _word_parts(marks: np.ndarray, parts: int) -> list[int]:
    """Where the words of each part begin and end, among words in order of their marks."""
    return np.searchsorted(marks * parts >> 32, np.arange(parts + 1)).tolist()


def _shares(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The words of each block by part."""
    for batch in batches:
        for block, lang, words, marks, counts in zip(*batch.columns, strict=True):
            counts, ends = _wide(counts.as_py()), _word_parts(_wide(marks.as_py()), parts)
            rows = [
                {"block": block.as_py(), "lang": lang.as_py(), "part": part, "words": words.values[a:b].to_pylist(), "counts": _narrow(counts[a:b])}
                for part, (a, b) in enumerate(zip(ends, ends[1:]))
                if b > a
            ]
            yield pa.RecordBatch.from_pylist(rows, SHARES)


def _merge_words(key: tuple, table: pa.Table, least: int, parts: int) -> pa.Table:
    """Sums over the words of one part: frequent words with their numbers, the numbers for each block, sums by language."""
    part = key[0].as_py()
    sizes = pc.list_value_length(table.column("words")).to_numpy()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(), sizes)
    words = pa.chunked_array([c.flatten() for c in table.column("words").chunks]).combine_chunks().dictionary_encode()
    counts = np.concatenate([_wide(c.as_py()) for c in table.column("counts")])
    each, entry = np.unique(lang.astype(np.int64) * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True)
    sums = np.zeros(len(each), np.int64)
    np.add.at(sums, entry, counts)
    chosen = np.flatnonzero(sums >= least)
    number = np.zeros(len(each), np.int64)
    number[chosen] = np.arange(len(chosen)) * parts + part + 1
    told = np.split(number[entry], np.cumsum(sizes)[:-1])
    rows = [{"block": block, "part": part, "ids": _narrow(ids)} for block, ids in zip(table.column("block").to_pylist(), told, strict=True) if ids.any()]
    own, word = np.divmod(each, len(words.dictionary))
    named = langs.dictionary.take(own[chosen]), words.dictionary.take(word[chosen])
    rows += [{"lang": a, "word": b, "f": f, "id": i} for a, b, f, i in zip(*(n.to_pylist() for n in named), sums[chosen].tolist(), number[chosen].tolist(), strict=True)]
    by_lang = np.zeros(len(langs.dictionary), np.int64)
    np.add.at(by_lang, own, sums)
    rows += [{"lang": a, "f": n} for a, n in zip(langs.dictionary.to_pylist(), by_lang.tolist(), strict=True)]
    return pa.Table.from_pylist(rows, WORDS)


def runs(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The words that stretches of neighbouring n-grams cover, with a zero after each stretch.

    ``starts`` says of each place whether an n-gram of k words that counts begins there. Stretches of a single n-gram
    hold none that is longer, so they go.
    """
    edges = np.diff(np.concatenate(([0], starts.astype(np.int8), [0])))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    first, last = first[last > first], last[last > first]
    if not len(first):
        return np.empty(0, np.int64)
    sizes = last - first + k + 1
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
    out = ids[np.minimum(place, len(ids) - 1)]
    out[ends - 1] = 0
    return out


def _ngrams(ids: np.ndarray, packing: Packing) -> tuple[CountingQuotientFilter, np.ndarray, np.ndarray]:
    """The filter of all n-grams of a block, where they begin, and which entry each is."""
    n, k = max(0, len(ids) - packing.k + 1), packing.k
    whole = np.logical_and.reduce([ids[i : i + n] != 0 for i in range(k)])
    places = np.flatnonzero(whole)
    found, entry = CountingQuotientFilter.of([ids[places + i] for i in range(k)], packing)
    return found, places, entry


def _level_rows(block: int, ids: np.ndarray, packing: Packing, parts: int) -> Iterator[pa.RecordBatch]:
    """A block's runs, and its n-grams by part."""
    if not len(ids):
        return
    found, _, _ = _ngrams(ids, packing)
    rows, before = [{"block": block, "part": OWN, "data": _narrow(ids)}], 0
    for part, end in enumerate(found.cuts(parts).tolist()):
        if end > before:
            rows.append({"block": block, "part": part, "data": found.to_bytes(before, end)})
        before = end
    yield pa.RecordBatch.from_pylist(rows, LEVEL)


def _pairs(batches: Iterator[pa.RecordBatch], bits: int, parts: int, word_parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the numbers of their frequent words: runs of frequent words, and pairs of these."""
    for batch in batches:
        for block, marks, ranks, own, told in zip(*batch.columns, strict=True):
            ranks, ends = _wide(ranks.as_py()), _word_parts(_wide(marks.as_py()), word_parts)
            numbers = np.zeros(len(ranks) + 1, np.int64)
            for part, ids in zip(told.values.field("part").to_pylist(), told.values.field("ids"), strict=True):
                numbers[ranks[ends[part] : ends[part + 1]]] = _wide(ids.as_py())
            ids = numbers[_wide(own.as_py())]
            yield from _level_rows(block.as_py(), runs(ids, ids != 0, 1), Packing(2, bits), parts)


def _longer(batches: Iterator[pa.RecordBatch], bits: int, parts: int, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks with what they were told of their n-grams of k words: runs of frequent ones, and n-grams of a word more."""
    for batch in batches:
        for block, data, told in zip(*batch.columns, strict=True):
            ids = _wide(data.as_py())
            found, places, entry = _ngrams(ids, Packing(k, bits))
            frequent, ends = np.zeros(len(found.counts), np.uint8), np.append(0, found.cuts(parts)).tolist()
            for part, mine in zip(told.values.field("part").to_pylist(), told.values.field("bits"), strict=True):
                first, last = ends[part : part + 2]
                frequent[first:last] = np.unpackbits(np.frombuffer(mine.as_py(), np.uint8), count=last - first)
            starts = np.zeros(len(ids), bool)
            starts[places] = frequent[entry] != 0
            yield from _level_rows(block.as_py(), runs(ids, starts, k), Packing(k + 1, bits), parts)


def _merge(key: tuple, table: pa.Table, packing: Packing, least: int) -> pa.Table:
    """Sums over the filters of one part: frequent n-grams, and a bit per entry for each block that has any."""
    filters = [CountingQuotientFilter.from_bytes(data.as_py(), packing) for data in table.column("data")]
    total, entry = merged(filters)
    frequent = total.counts >= least
    chosen = np.flatnonzero(frequent)
    at, rows = 0, []
    for block, own in zip(table.column("block").to_pylist(), filters, strict=True):
        mine = frequent[entry[at : at + len(own.counts)]]
        at += len(own.counts)
        if mine.any():
            rows.append({"block": block, "part": key[0].as_py(), "bits": np.packbits(mine).tobytes()})
    told = pa.RecordBatch.from_pylist(rows, MERGED)
    kept = CountingQuotientFilter(packing, [lane[chosen] for lane in total.lanes], total.counts[chosen])
    words = np.stack([w.astype(np.int64) for w in kept.words()], axis=1)
    nothing = pa.nulls(len(chosen))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1) * packing.k, pa.int32()), pa.array(words.reshape(-1)))
    found = pa.RecordBatch.from_arrays([nothing.cast(pa.int64()), nothing.cast(pa.int32()), nothing.cast(pa.binary()), lists, pa.array(kept.counts)], schema=MERGED)
    return pa.Table.from_batches([told, found], MERGED)


def _merging(packing: Packing, least: int):
    return lambda key, table: _merge(key, table, packing, least)


def frequent_phrases(docs: DataFrame, least: int, longest: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lang, n)``; words ``(id, lang, word, f)`` and phrases ``(ids, f)`` of up to ``longest`` words that occur
    ``least`` times or more in their language."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    blocks = written(named.mapInArrow(_blocks, BLOCKS_DDL), "blocks")
    entries = blocks.agg(F.sum("entries")).first()[0] or 0
    word_parts = max(1, math.ceil(entries / RANGE_WORDS))
    shares = blocks.select("block", "lang", "words", "marks", "counts").mapInArrow(lambda it: _shares(it, word_parts), SHARES_DDL)
    counted = written(shares.groupBy("part").applyInArrow(lambda key, table: _merge_words(key, table, least, word_parts), WORDS_DDL), "words")
    totals = counted.filter("word IS NULL AND lang IS NOT NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    words = counted.filter("word IS NOT NULL").select("id", "lang", "word", "f")
    size, highest = words.agg(F.sum("f"), F.max("id")).first()
    bits, parts = max(1, (highest or 0).bit_length()), max(1, math.ceil((size or 0) / RANGE_WORDS))

    told = counted.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "ids")).alias("told"))
    pairs = blocks.select("block", "marks", "ranks", "ids").join(told, "block")
    level = written(pairs.mapInArrow(lambda it: _pairs(it, bits, parts, word_parts), LEVEL_DDL), "pairs")
    phrases = words.select(F.array("id").alias("ids"), "f")
    for k in range(2, longest + 1):
        packing = Packing(k, bits)
        found = level.filter(F.col("part") != OWN).groupBy("part").applyInArrow(_merging(packing, least), MERGED_DDL)
        found = written(found, "merged")
        phrases = phrases.unionByName(found.filter("block IS NULL").select("ids", "f"))
        told = found.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("told"))
        if k == longest or told.isEmpty():
            break
        own = level.filter(F.col("part") == OWN).select("block", "data").join(told, "block")
        level = written(own.mapInArrow(lambda it, k=k: _longer(it, bits, parts, k), LEVEL_DDL), "level")
    return totals, words, phrases


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language by the ratio of their count to what their parts would make by chance.

    ``lang, rank, phrase, a, l, r, n, score``: ``score`` is ``floor(1000 * a * n / (l * r))`` for the cut of the phrase
    where it is least. A phrase inside a longer one that occurs as often is left out. One word more is enough to look at:
    counts never rise with the length, so with a longer phrase everything between the two occurs as often.
    """
    totals, words, phrases = frequent_phrases(docs, least, longest, text, lang)
    several = phrases.filter(F.size("ids") > 1)
    size = F.size("ids")
    inside = several.filter(size > 2).select(
        F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f"
    )
    inside = inside.groupBy("ids").agg(F.max("f").alias("longer"))
    kept = several.join(inside, "ids", "left").filter(F.coalesce(F.col("longer") < F.col("f"), F.lit(True)))
    kept = kept.join(words.select(F.col("id").alias("_id"), "lang"), F.get("ids", F.lit(0)) == F.col("_id")).join(totals, "lang")
    cut = kept.select("ids", "lang", "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"first": F.slice("ids", F.lit(1), F.col("k")), "rest": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cut = cut.join(phrases.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first")
    cut = cut.join(phrases.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    exact = {name: _exact(name) for name in ("a", "n", "l", "r")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"], exact["l"] * exact["r"])
    scored = cut.groupBy("ids", "lang", "n", "a").agg(F.array_min(F.collect_list(F.struct(score.alias("score"), "k", "l", "r"))).alias("least"))
    said = scored.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    said = said.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    named = scored.join(said, "ids").select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
