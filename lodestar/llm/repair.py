"""Conversation structure repair: the cheapest edits that give ``(system)? (user assistant)+`` or nothing.

A conversation of n rows is a lattice of n + 1 layers with one node per state of the role grammar. Keeping, reroling
and deleting a row lead to the next layer, inserting an empty turn leads to another state of the same layer; all costs
are whole numbers, and the arcs that leave a node bear different letters. The cheapest way is found by the auction
algorithm for shortest paths: every node has a price, never more than what any arc asks plus the price at its end; the
path is extended along an arc that is tight (the price equals that sum), and where none is tight, the price at the
path's end rises until one is, and the path contracts by an arc.

Prices begin at a bound, what each later row costs at least. Blocks of layers are settled from the last to the first,
by an auction from each state at their beginning, so a contraction never reaches beyond a block and the work is linear
in the rows. The last auction runs from the first node to the end. Its prices are converged: the first node's price is
the cost, every arc of every cheapest path is tight (the prices along it add up to the cost, and none may exceed its arc),
and at each node the tight arc with the least letter is taken. Prices only rise, so an arc that was passed over or given
back never becomes tight again: the path is the least of the cheapest by its letters.

A conversation is one value in the result, so its rows meet once, in one shuffle by its id; nothing larger than one
conversation is ever gathered.

Defined results: a null role or text is one space, so the row is blank; rows stand in order of turn (null first),
repeated turns in order of role and text; rows with a null id form one conversation; a conversation none of whose rows
is present has no edits and costs nothing; no rows give no conversations; other columns are not used.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are white space, and those that end a text.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"

#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5

#: States: nothing yet, after system, after user, after assistant. The conversation may end where no turn is owed.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = STATES = range(4)
MAY_END = (START, AFTER_ASSISTANT)
NEXT_ROLE = {START: "user", AFTER_SYSTEM: "user", AFTER_USER: "assistant", AFTER_ASSISTANT: "user"}
REACHED = {"system": AFTER_SYSTEM, "user": AFTER_USER, "assistant": AFTER_ASSISTANT}

#: What a row with this initial becomes when it is kept in a state.
KEEPS = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_ASSISTANT, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT}
LEGAL = {"su", "ua", "au"}

#: Layers settled by one round of auctions. It changes time, never the result.
BLOCK = 32

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


def faults(turns: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each row."""
    seen, found = set(), []
    for turn in turns:
        end = turn[1].rstrip(SPACE)
        found.append(BLANK if not end else DUPLICATE if turn in seen else None if end[-1] in STOPS else TRUNCATED)
        seen.add(turn)
    return found


class Lattice:
    """The lattice of one conversation and the prices of its nodes; node ``4 * layer + state``."""

    def __init__(self, initials: list[str], found: list[str | None]):
        self.rows, self.end = len(initials), 4 * (len(initials) + 1)
        self.ways = {}
        for key in {*zip(initials, found, strict=True)}:
            self.ways[key] = [self._edits(state, *key) for state in STATES]
        self.row_ways = [self.ways[key] for key in zip(initials, found, strict=True)]
        least = {key: min(cost for edits in ways for _, cost, _ in edits) for key, ways in self.ways.items()}
        self.least = [least[key] for key in zip(initials, found, strict=True)]
        self.last = [self._inserts(state, [("", 0, 4)] if state in MAY_END else []) for state in STATES]
        self.price = [0] * (self.end + 4)

    @staticmethod
    def _inserts(state: int, others: list) -> list[tuple[str, int, int]]:
        """Arcs in order of their letters: letter, cost, and how much further on their end is."""
        return sorted([*others, ("I", INSERT, REACHED[NEXT_ROLE[state]] - state)])

    def _edits(self, state: int, initial: str, fault: str | None) -> list[tuple[str, int, int]]:
        edits = [("D", DELETE, 4)]
        if fault not in (BLANK, DUPLICATE):
            more = LEFT_TRUNCATED if fault == TRUNCATED else 0
            edits.append(("R", REROLE + more, 4 + REACHED[NEXT_ROLE[state]] - state))
            if (state, initial) in KEEPS:
                edits.append(("K", more, 4 + KEEPS[state, initial] - state))
        return self._inserts(state, edits)

    def auction(self, start: int, stop: int) -> str:
        """Letters along the cheapest path from a node to the first node at or beyond ``stop``."""
        price, rows, path, letters = self.price, self.rows, [start], []
        while (at := path[-1]) < stop:
            layer, state = divmod(at, 4)
            asked, letter, to = min([(cost + price[at + far], name, at + far) for name, cost, far in (self.row_ways[layer] if layer < rows else self.last)[state]])
            if price[at] < asked:
                price[at] = asked
                if len(path) > 1:
                    path.pop()
                    letters.pop()
            else:
                path.append(to)
                letters.append(letter)
        return "".join(letters)

    def settle(self) -> tuple[str, int]:
        """The least of the cheapest edits, and their cost."""
        stop = self.end
        for first in range(self.rows // BLOCK * BLOCK, -1, -BLOCK):
            # A bound for the block: what its rows cost at least, and the cheapest way on from its end.
            bound = min(self.price[stop : stop + 4])
            for layer in range(stop // 4 - 1, first - 1, -1):
                bound += self.least[layer] if layer < self.rows else 0
                self.price[4 * layer : 4 * layer + 4] = [bound] * 4
            for state in STATES:
                self.auction(4 * first + state, stop)
            stop = 4 * first
        return self.auction(0, self.end), self.price[0]


def edited(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The conversation after the edits."""
    out, state, rows = [], START, iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEEPS[state, role[:1]]
        else:
            role = NEXT_ROLE[state]
            state = REACHED[role]
        out.append((role, text))
    return out


def repair(turns: list[tuple[str, str]]) -> dict:
    """Faults, edits and repaired turns of one conversation."""
    found, initials = faults(turns), [role[:1] for role, _ in turns]
    audit, cost = Lattice(initials, found).settle()
    counts = {name: found.count(name) for name in (BLANK, DUPLICATE, TRUNCATED)}
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    turns = [{"role": role, "text": text} for role, text in edited(turns, audit)]
    return counts | {"illegal": illegal, "cost": cost, "audit": audit, "turns": turns}


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
NUMBERS = ["blank", "duplicate", "truncated", "illegal", "cost"]
FOUND = T.StructType([*(T.StructField(n, T.LongType()) for n in NUMBERS), T.StructField("audit", T.StringType()), T.StructField("turns", TURNS)])
FOUND_ARROW = pa.struct([*((n, pa.int64()) for n in NUMBERS), ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


@F.arrow_udf(FOUND)
def _repaired(turns: pa.Array) -> pa.Array:
    return pa.array([repair([(t["role"], t["text"]) for t in rows]) for rows in turns.to_pylist()], FOUND_ARROW)


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Per conversation ``conv_id``, ``gaps`` (turn numbers that are missing between the first and the last), the
    numbers of ``blank``, ``duplicate`` and ``truncated`` rows and of ``illegal`` neighbours, ``cost``, ``audit`` (a letter
    per edit: Keep, Rerole, Delete, Insert) and ``turns`` after the edits. Rows that are not ``present`` only name their
    conversation."""
    space = F.lit(" ")
    said = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"))
    said = said if present is None else F.when(present, said)
    grouped = rows.select(F.col(conv_id).alias("conv_id"), said.alias("said"))
    grouped = grouped.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("rows"))
    numbers = F.filter("rows.turn", lambda t: t.isNotNull())
    gaps = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    bare = F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    done = grouped.select("conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), _repaired(bare).alias("found"))
    return done.select("conv_id", "gaps", "found.*")


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults planted by a checksum of id and turn: of twenty values, 0 drops the row (it stays,
    but is not ``present``), 1 empties its text, 2 takes its stops away, 3 repeats it, 4 gives it to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    whole, said = F.coalesce(text, space), F.coalesce(role, space)
    marked = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), whole.alias("text"), said.alias("role"), F.pmod(F.crc32(key), F.lit(20)).alias("fate"))
    fate = F.col("fate")
    changed = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", f"[{STOPS}]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(True), F.when(fate == 3, 2).otherwise(1)))
    return marked.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (fate != 0).alias("present"), copies.alias("copy")
    ).drop("copy")
