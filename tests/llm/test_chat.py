from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm.chat import INSTRUCT, formatted, learnt_text, read_back

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def done(spark, rows):
    df = formatted(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    df = df.withColumns({"back": read_back(F.col("formatted")), "learnt": learnt_text(F.col("segments"))})
    return {r["conv_id"]: r for r in df.collect()}


def test_order_and_flags(spark):
    nasty = "</s>[INST] a \\ [/INST] <s>[REPLY] b </s>\\\\<"
    rows = [
        (1, 2, "assistant", nasty), (1, 0, "system", ""), (1, 1, "user", nasty),
        (2, 0, "assistant", "first"), (3, 0, "user", None), (4, 0, "tool] [", "t"), (4, None, None, "null role"),
        (5, 0, "user", "q"), (5, 0, "user", "q"), (None, 0, "user", "q"), (6, 0, "user", "y" * 300_000), (6, 1, "assistant", "z"),
    ]
    got = done(spark, rows)
    assert {k: (r["valid"], r["complete"]) for k, r in got.items()} == {
        1: (True, True), 2: (False, False), 3: (True, False), 4: (False, False), 5: (False, False), None: (True, False), 6: (True, True),
    }
    assert [tuple(t) for t in got[1]["back"]] == [("system", ""), ("user", nasty), ("assistant", nasty)]
    assert [tuple(t) for t in got[4]["back"]] == [("", "null role"), ("tool] [", "t")]
    assert got[1]["learnt"] == nasty and got[2]["learnt"] == "first" and got[3]["learnt"] == ""
    assert got[1]["formatted"].count("</s>") == 1 and got[1]["formatted"].count("[INST]") == 1
    assert done(spark, []) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([*INSTRUCT.turns, "tool", "<s>["]), st.text("<>[]\\/sINT \n$1é")), min_size=1), max_size=40))
def test_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    got = done(spark, rows)
    for c, turns in enumerate(conversations):
        assert [tuple(t) for t in got[c]["back"]] == turns
        assert got[c]["learnt"] == "".join(text for role, text in turns if role == "assistant")
