import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import repair
from lodestar.llm.queries import op12_conversation_repair

FOLDER = "/root/testdata/sf0.01"


def first_faults(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        seen = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        out.append("b" if not seen else "d" if (role, text) in rows[:i] else "" if seen[-1] in ".!?" else "t")
    return out


def slow_audit(rows):
    """Cheapest (cost, letters) by dynamic programming over (rows left, last role), all edits tried everywhere."""
    marks, after = first_faults(rows), {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    best = {}
    for i in range(len(rows), -1, -1):
        here = {}
        for last in after:
            ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
            if i < len(rows):
                (role, text), nxt = rows[i], best[i + 1]
                ways.append((2 + nxt[last][0], "D" + nxt[last][1], nxt[last][2]))
                if marks[i] not in ("b", "d"):
                    more = 5 if marks[i] == "t" else 0
                    if role[:1] in after[last]:
                        c, a, t = nxt[role[:1]]
                        ways.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                    for other in ("user", "assistant"):
                        if other[0] in after[last]:
                            c, a, t = nxt[other[0]]
                            ways.append((c + more + 1, "R" + a, (f"{other}:{text}", *t)))
            here[last] = min(ways, default=(10**9, "", ()))
        for _ in range(3):
            for last in after:
                for other in ("user", "assistant"):
                    if other[0] in after[last]:
                        c, a, t = here[other[0]]
                        here[last] = min(here[last], (c + 5, "I" + a, (f"{other}:", *t)))
        best[i] = here
    return best[0][""]


def agrees(rows):
    got, marks = repair.repair(rows), first_faults(rows)
    cost, audit, turns = slow_audit(rows)
    assert (got["cost"], got["audit"]) == (cost, audit), rows
    assert [f"{t['role']}:{t['text']}" for t in got["turns"]] == list(turns)
    assert [got["blank"], got["duplicate"], got["truncated"]] == [marks.count(c) for c in "bdt"]


ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", " ", "tool", "", "user2"]), st.sampled_from(["a.", "b!", "c", "d? \n", "", " \t", "e.", "f?"])), max_size=14)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_cheapest_and_least(rows):
    agrees(rows)


@pytest.mark.parametrize("block", [1, 2, 32])
def test_long_conversations(block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for n in (31, 32, 33, 64, 200):
        roles = rng.choices(["user", "assistant", "system"], [5, 5, 1], k=n)
        agrees([(role, rng.choice(["yes", "no."]) + str(rng.randrange(60)) + rng.choice([".", ".", ""])) for role in roles])


def test_one_very_long_conversation():
    rows = [(("assistant", "user", "user")[i % 3], f"text {i}{'.' if i % 7 else ''}") for i in range(30_000)]
    got = repair.repair(rows)
    roles = "".join(t["role"][0] for t in got["turns"])
    assert roles == "ua" * (len(roles) // 2) and got["truncated"] == sum(i % 7 == 0 for i in range(30_000))
    assert got["cost"] == slow_cost(rows)


def slow_cost(rows):
    best = {"": 0, "s": 10**9, "u": 10**9, "a": 10**9}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    for (role, _), mark in zip(rows, ["" if t.endswith(".") else "t" for _, t in rows]):
        for _ in range(3):
            for last in follows:
                for to in follows[last].replace("s", ""):
                    best[to] = min(best[to], best[last] + 5)
        nxt = {last: c + 2 for last, c in best.items()}
        for last, c in best.items():
            for to in follows[last]:
                if to == role[0] or to in "ua":
                    nxt[to] = min(nxt[to], c + (5 if mark else 0) + (to != role[0]))
        best = nxt
    return min(best[""], best["a"], best["u"] + 5, best["s"] + 10)


def test_odd_rows(spark):
    rows = [(1, None, "user", "hello."), (1, 5, None, None), (1, 2, "assistant", "x" * 200_000), (None, 0, "user", "q?"), (2, 7, "user", "a."), (2, 7, "user", "a.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gaps int")
    got = {r["conv_id"]: r for r in repair.repaired(df).collect()}
    assert got[1]["gaps"] == 2 and got[1]["blank"] == 1 and got[1]["truncated"] == 1 and got[1]["audit"] == "DDD"
    assert got[None]["audit"] == "D" and got[2]["audit"] == "DD" and got[2]["duplicate"] == 1
    assert repair.repaired(df.limit(0)).count() == 0
    gone = repair.repaired(df, present=F.lit(False)).collect()
    assert len(gone) == 3 and all(r["audit"] == "" and r["cost"] == r["gaps"] == 0 and r["turns"] == [] for r in gone)


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    rows = {}
    for r in table:
        key = f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}"
        fate, role, text = zlib.crc32(key.encode()) % 20, r["role"] or " ", " " if r["text"] is None else r["text"]
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        rows.setdefault(r["conv_id"], []).extend([(r["turn"], "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1))
    got = {r["conv_id"]: r for r in op12_conversation_repair(spark, FOLDER).collect()}
    assert got.keys() == rows.keys() and len(got) > 50
    for conv, said in rows.items():
        said.sort()
        bare, numbers = [(role, text) for _, role, text in said], [turn for turn, _, _ in said]
        cost, audit, turns = slow_audit(bare)
        marks = first_faults(bare)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(bare, bare[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        want = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, digest)
        assert tuple(got[conv][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == want
