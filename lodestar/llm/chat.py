"""Chat formatting: a template per role, a state machine over the roles, and segments with loss flags.

A template is data: what opens and closes a turn of a role, and whether its text is learnt. The characters that
begin or end control strings are escaped inside texts and roles by a backslash after them, so no text can
open or close a turn, and reading a formatted conversation back gives exactly what went in.

The rows of a conversation meet once, in one shuffle by its id, because the result is one value per
conversation; nothing larger than one conversation is ever gathered.

Defined results: a null text is empty, a null role is the empty role; roles outside the template keep their name in a
general turn without loss and make the conversation invalid; turns are ordered by number (null first), repeated
numbers by role and text, and repeated rows stay; rows with a null id form one conversation; no rows give no
conversations; other columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A control string begins with one of these, and inside texts a backslash follows each of them.
SPECIALS = r"([<\[\]\\])"


@dataclass(frozen=True)
class Turn:
    """How the turns of one role are written."""

    label: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``opening`` begins every turn; the label and ``after`` complete it. Roles not listed are written with ``other``."""

    turns: dict[str, Turn]
    other: Turn
    follows: dict[str, tuple[str, ...]]  # state, which is the last role or "", to the roles that may come next
    opening: str = "<s>["
    after: str = "] "


INSTRUCT = Template(
    turns={
        "system": Turn("SYS", " [/SYS]"),
        "user": Turn("INST", " [/INST]"),
        "assistant": Turn("REPLY", " </s>", loss=True),
    },
    other=Turn("ROLE ", " [/ROLE]"),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, SPECIALS, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, SPECIALS + r"\\", "$1")


def _per_role(role: Column, template: Template, value, otherwise: Column) -> Column:
    chosen = otherwise
    for name, turn in template.turns.items():
        chosen = F.when(role == name, value(turn)).otherwise(chosen)
    return chosen


def _segments(turn: Column, template: Template) -> Column:
    """Opening, text and closing of a turn, each with its loss flag."""
    role = turn["role"]
    label = _per_role(role, template, lambda t: F.lit(t.label), F.concat(F.lit(template.other.label), escaped(role)))
    closing = _per_role(role, template, lambda t: F.lit(t.closing), F.lit(template.other.closing))
    loss = _per_role(role, template, lambda t: F.lit(t.loss), F.lit(template.other.loss))
    segment = lambda text, learnt: F.struct(text.alias("text"), learnt.alias("loss"))
    no = F.lit(False)
    opening = F.concat(F.lit(template.opening), label, F.lit(template.after))
    return F.array(segment(opening, no), segment(escaped(turn["text"]), loss), segment(closing, no))


def _state(turns: Column, template: Template) -> Column:
    """Last role when every turn may follow the one before, otherwise null."""
    moves = [(a, b) for a, following in template.follows.items() for b in following]

    def step(state: Column, turn: Column) -> Column:
        allowed = F.lit(False)
        for a, b in moves:
            allowed = allowed | ((state == a) & (turn["role"] == b))
        return F.when(allowed, turn["role"])

    return F.aggregate(turns, F.lit(""), step)


def formatted(rows: DataFrame, template: Template = INSTRUCT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation ``conv_id``, ``segments`` (array of text and loss flag), ``formatted`` (their texts, joined),
    ``valid`` (the turns follow the state machine) and ``complete`` (valid, and the last turn is one with loss)."""
    said = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    df = rows.select(F.col(conv_id).alias("conv_id"), said.alias("said"))
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    df = df.withColumn("segments", F.flatten(F.transform("turns", lambda t: _segments(t, template))))
    learnt = [name for name, t in template.turns.items() if t.loss]
    state = _state(F.col("turns"), template)
    return df.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        state.isNotNull().alias("valid"),
        F.coalesce(state.isin(learnt), F.lit(False)).alias("complete"),
    )


def read_back(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    quoted = template.opening.replace("[", r"\[")
    pieces = F.filter(F.split(text, f"(?={quoted})"), lambda piece: piece != "")

    def turn(piece: Column) -> Column:
        start, end = len(template.opening) + 1, F.locate(template.after, piece)
        label = F.substr(piece, F.lit(start), end - start)
        role = unescaped(F.substr(label, F.lit(len(template.other.label) + 1)))
        closing = F.lit(len(template.other.closing))
        for name, t in template.turns.items():
            role = F.when(label == t.label, F.lit(name)).otherwise(role)
            closing = F.when(label == t.label, F.lit(len(t.closing))).otherwise(closing)
        body = F.substr(piece, end + len(template.after), F.length(piece) - closing - end - len(template.after) + 1)
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def learnt_text(segments: Column) -> Column:
    """All text under the loss flags, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
