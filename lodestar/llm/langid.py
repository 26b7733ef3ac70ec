"""Language identification by cross-parsing.

Each language has a suffix automaton over a bounded sample of its labelled text. A text is cut greedily into the
longest phrases that occur in that sample: the automaton is followed until it has no way on, then a new phrase begins.
The language that needs the fewest phrases per character wins. All documents are parsed whole: pieces go side by side
through the automaton, which is a table, and are then joined as one parse from the beginning to the end; the sample is all that travels.

Defined results: a null text, and one without a letter, is ``und`` with score 0; equal numbers of phrases go to the
first language by name, with score 0; without any labelled text everything is ``und``; a single language always wins,
with score 1; repeated rows are judged one by one; other columns pass through in ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import with_row

UNDETERMINED = "und"

#: Characters of a piece, and how many pieces go side by side. They change time and memory, never the result.
PIECE, SIDE_BY_SIDE = 256, 8192

#: Characters turned into symbols at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class SampleBound:
    """What is learnt from: of each language at most so many rows, of a row at most a piece of so many characters, and
    characters in all languages together, but some of each, however many they are. Every labelled language is learnt. If
    ``row_chars`` is set, longer rows are left out."""

    rows: int = 60
    piece: int = 20_000
    row_chars: int | None = None
    chars: int = 120_000
    least_chars: int = 2_000


def sample(labelled: DataFrame, bound: SampleBound | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """Labelled text per language, spread over the rows by a hash of their id."""
    bound = bound or SampleBound()
    fit = labelled.select(
        F.col(lang).alias("lang"), F.length(text).alias("length"), F.substring(text, 1, bound.piece).alias("text"), F.xxhash64(F.col(doc_id).cast("string")).alias("place")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if bound.row_chars is not None:
        fit = fit.filter(F.col("length") <= bound.row_chars)
    counts = fit.groupBy("lang").count().collect()
    if not counts:
        return ()
    share = max(bound.chars // len(counts), min(bound.chars, bound.least_chars))
    # Twice the rows needed, by a threshold on the hash; then exactly as many.
    chances = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 2 * bound.rows / r["count"])])
    chance = F.coalesce(chances[F.col("lang")], F.lit(0.0))
    near = fit.filter(F.pmod("place", F.lit(1 << 30)) < chance * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 30)), "place", "text")
    rows = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= bound.rows).orderBy("lang", "n")
    texts: dict[str, str] = {}
    for r in rows.select("lang", F.substring("text", 1, share).alias("text")).collect():
        texts[r["lang"]] = texts.get(r["lang"], "") + " " + r["text"]
    return tuple(sorted((name, t[:share]) for name, t in texts.items()))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions per state; state 0 is the start, and every path spells a substring."""
    ways: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for s in symbols:
        state, at = len(ways), last
        ways.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        while at >= 0 and s not in ways[at]:
            ways[at][s] = state
            at = link[at]
        if at >= 0:
            target = ways[at][s]
            if longest[target] == longest[at] + 1:
                link[state] = target
            else:
                copy = len(ways)
                ways.append(dict(ways[target]))
                link.append(link[target])
                longest.append(longest[at] + 1)
                link[target] = link[state] = copy
                while at >= 0 and ways[at].get(s) == target:
                    ways[at][s] = copy
                    at = link[at]
        last = state
    return ways


class Dense:
    """Ways of one automaton as a table: 2 * next row, plus 1 where a new phrase begins. Rows are already multiplied by
    the width. Row 0 is outside the automaton: there a parse begins, and there it is after a symbol that the sample lacks."""

    def __init__(self, ways: list[dict[int, int]], width: int):
        table = np.zeros((len(ways) + 1, width), np.int32)
        for state, own in enumerate(ways):
            table[state + 1, list(own)] = np.fromiter(own.values(), np.int32, len(own)) + 1
        fresh = table == 0
        table = np.where(fresh, table[1], table) * width * 2 + fresh
        table[:, width - 1] = 0
        self.table = table.astype(np.int32).ravel()

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self.table.take(state + column)


class Sparse:
    """The same by hash, a quarter full, for alphabets of thousands of letters: states are rows, not multiplied."""

    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, ways: list[dict[int, int]], width: int):
        self.width = width
        self.first = np.zeros(width, np.int64)
        for s, to in ways[0].items():
            self.first[s] = to + 1
        keys = np.array([(state + 1) * width + s for state, own in enumerate(ways) if state for s in own], np.int64)
        targets = np.array([to + 1 for state, own in enumerate(ways) if state for to in own.values()], np.int64)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            put = self.keys[slot] == keys[left]
            self.targets[slot[put]] = targets[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.FACTOR) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        keys = state.astype(np.int64) * self.width + column
        slot = self._slots(keys)
        at = self.keys.take(slot)
        going = np.where(at == keys, self.targets.take(slot), 0)
        left = np.flatnonzero((at != keys) & (at >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            at = self.keys[slot[left]]
            hit = at == keys[left]
            going[left[hit]] = self.targets[slot[left[hit]]]
            left = left[~hit & (at >= 0)]
        fresh = (going == 0) & (column != self.width - 1)
        return np.where(fresh, self.first.take(column), going) * 2 + fresh


class Parser:
    """Automata of all languages. Symbols are 0, a break between words, the letters of all samples, and at the end a
    letter that no sample has and padding; each language maps them to its own letters in the same way."""

    #: Entries that the tables of all languages may have together; an automaton beyond its share is held by hash.
    ENTRIES = 1 << 26

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [name for name, _ in samples]
        letters = sorted({c for _, t in samples for c in t.lower() if c.isalpha()})
        self.strange, self.padding = len(letters) + 1, len(letters) + 2
        self.symbol = np.fromiter((self.strange if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000)
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = i + 1
        self.tables = [self._table(self.symbols(t)) for _, t in samples]

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text in lower case; breaks in a row count once."""
        parts = [np.frombuffer(text[a : a + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4") for a in range(0, len(text), SLICE)]
        found = self.symbol[np.concatenate(parts)] if parts else np.empty(0, np.int32)
        again = np.zeros(len(found), bool)
        again[1:] = (found[1:] == 0) & (found[:-1] == 0)
        return found[~again]

    def _table(self, symbols: np.ndarray) -> tuple[np.ndarray, Dense | Sparse]:
        """The language's own number of each symbol, and its automaton."""
        own = np.unique(symbols[symbols > 0])
        numbers = np.full(self.padding + 1, len(own) + 1, np.int32)
        numbers[own] = np.arange(1, len(own) + 1)
        numbers[0], numbers[self.padding] = 0, len(own) + 2
        width = len(own) + 3
        ways = suffix_automaton(numbers[symbols].tolist())
        dense = (len(ways) + 1) * width <= self.ENTRIES // len(self.languages)
        return numbers, (Dense if dense else Sparse)(ways, width)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and symbols per text; no symbols where there is no letter."""
        count = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.zeros(len(texts), np.int64)
        carried = np.zeros(len(self.languages), np.int32)
        waiting, owner, begins, held = [], [], [], 0

        def parse() -> None:
            nonlocal waiting, owner, begins, held
            if held:
                self._parse(np.concatenate(waiting), np.concatenate(owner), np.concatenate(begins), carried, count)
            waiting, owner, begins, held = [], [], [], 0

        for i, text in enumerate(texts):
            symbols = self.symbols(text)
            if not symbols.any():
                continue
            sizes[i] = len(symbols)
            pieces = -(-len(symbols) // PIECE)
            padded = np.full(pieces * PIECE, self.padding, np.int32)
            padded[: len(symbols)] = symbols
            for a in range(0, pieces, SIDE_BY_SIDE):
                part = padded[a * PIECE : (a + SIDE_BY_SIDE) * PIECE].reshape(-1, PIECE)
                waiting.append(part)
                owner.append(np.full(len(part), i))
                begins.append(np.arange(a, a + len(part)) == 0)
                held += len(part)
                if held >= SIDE_BY_SIDE:
                    parse()
        parse()
        return count, sizes

    def _parse(self, pieces: np.ndarray, owner: np.ndarray, begins: np.ndarray, carried: np.ndarray, count: np.ndarray) -> None:
        """Add the phrases of some pieces. ``carried`` is the state in which the parse of each language left the last piece.

        All pieces are first parsed from the beginning of a phrase. A piece that goes on with a text is then parsed once more
        from where the piece before has ended, until both parses are in the same state; from there on they are the same. That
        is repeated while the end of a piece changes, so the result is the parse of the whole text.
        """
        columns = np.ascontiguousarray(pieces.T)
        for k, (numbers, table) in enumerate(self.tables):
            own = numbers.take(columns)
            states = np.zeros((PIECE + 1, len(pieces)), np.int32)
            fresh = np.zeros((PIECE, len(pieces)), bool)
            for j in range(PIECE):
                step = table.step(states[j], own[j])
                states[j + 1], fresh[j] = step >> 1, step & 1
            while True:
                entry = np.concatenate((carried[k : k + 1], states[PIECE, :-1]))
                entry[begins] = 0
                live = np.flatnonzero(entry != states[0])
                if not len(live):
                    break
                states[0] = entry
                state = entry[live]
                for j in range(PIECE):
                    step = table.step(state, own[j][live])
                    fresh[j][live] = step & 1
                    state = (step >> 1).astype(np.int32)
                    apart = state != states[j + 1][live]
                    live, state = live[apart], state[apart]
                    if not len(live):
                        break
                    states[j + 1][live] = state
            carried[k] = states[PIECE, -1]
            count[:, k] += np.bincount(owner, weights=fresh.sum(axis=0), minlength=len(count)).astype(np.int64)


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rate", T.DoubleType())])


def verdicts(texts: list[str | None], samples: tuple[tuple[str, str], ...]) -> list[tuple[str, float, float | None]]:
    """Language, score (how much fewer phrases it needs than the next one, 0 to 1) and phrases per character."""
    if not samples:
        return [(UNDETERMINED, 0.0, None)] * len(texts)
    ready = parser(samples)
    count, sizes = ready.phrases([t or "" for t in texts])
    out: list[tuple[str, float, float | None]] = []
    for row, size in zip(count, sizes.tolist(), strict=True):
        if not size:
            out.append((UNDETERMINED, 0.0, None))
            continue
        best = int(row.argmin())
        rest = np.delete(row, best)
        out.append((ready.languages[best], 1 - row[best] / rest.min() if len(rest) else 1.0, row[best] / size))
    return out


def identified(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``lang_pred``, ``score`` and ``rate``, the phrases per character of the winner."""

    @F.arrow_udf(FOUND)
    def judge(texts: pa.Array) -> pa.Array:
        rows = verdicts(texts.to_pylist(), samples)
        return pa.array([dict(zip(FOUND.names, r, strict=True)) for r in rows], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rate", pa.float64())]))

    df = with_row(docs, keep, text=F.col(text)).select("row", judge("text").alias("found"))
    return df.select("row", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rate").alias("rate"))
