import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm.decontaminate import Matching, clean, found_items, windows
from lodestar.llm.queries import op10_template_windows

ITEM = "Each morning Alice walks 12 km to the old mill and then carries 12 bags of flour back to Alice in 3 hours."
OTHER = "Each morning Peter walks 45 miles to the old mill and then carries 45 bags of flour back to Peter in 9 days."
BROKEN = "Each morning Peter walks 45 miles to the old mill and then carries 77 bags of flour back to Susan in 9 days."
SCHEMA = "doc_id long, text string, at int"


def search(spark, docs, items, **options):
    docs = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA)
    items = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    rows, found = found_items(docs, items, **options)
    return {(r["row"]["doc_id"], r["item_id"]): r["changed"] for r in found.join(rows, "at").collect()}


def test_parameters(spark):
    pad = "Nothing of this is known to anyone who came by. "
    docs = [(1, pad + ITEM + pad), (2, pad + OTHER), (3, ITEM.lower().replace(" ", "  \n")), (4, pad), (5, None), (6, ""), (None, ITEM),
            (7, ITEM), (7, ITEM), (8, pad * 3000 + OTHER), (9, ITEM.upper()), (10, "and then to the old mill in hours " * 30)]
    got = search(spark, docs, [(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, pad), (4, "the old mill")])
    assert got == {(1, 1): False, (2, 1): True, (3, 1): False, (None, 1): False, (7, 1): False, (8, 1): True, (9, 1): False}


def test_inconsistent_slots_do_not_match(spark):
    items = [(1, ITEM)]
    assert search(spark, [(1, OTHER)], items, matching=Matching(covered=0.8)) == {(1, 1): True}
    assert search(spark, [(1, BROKEN)], items, matching=Matching(covered=0.8)) == {}


def test_short_items_and_empty_tables(spark):
    assert search(spark, [(1, "so: who ate 5 figs today?")], [(1, "Who ate 9 figs?"), (2, "ate figs")]) == {(1, 1): True}
    assert search(spark, [], [(1, ITEM)]) == {} == search(spark, [(1, ITEM)], [])


def test_clean_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (2, "fine", 6), (2, "fine", 6), (None, None, 7)], SCHEMA)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(map(str, clean(docs, items).collect())) == sorted(map(str, docs.collect()[1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("a b The cat 1 2,5 km . ! Bob\n".split(" ")), max_size=40))
def test_equal_windows_have_equal_hashes(tokens):
    """Windows agree exactly where their words do: copies of a text within another one are found at every place."""
    text = " ".join(tokens)
    plain = [w.lower() for w in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text)]
    for length, at, hashes, values, _ in windows(text, (3,), 2):
        if values is None:
            keys = [tuple(plain[i : i + length]) for i in at]
            assert len(set(zip(keys, hashes.tolist()))) == len(set(keys)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    """Every item whose words stand whole in a document, and nothing that shares less than a third of its five-word windows."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs = {d["doc_id"]: words(d["text"]) for d in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {b["item_id"]: words(b["text"]) for b in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op10_template_windows(spark, folder).collect()}
    some = 0
    for d, own in docs.items():
        text, fives = " ".join(own), {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for b, item in items.items():
            parts = [tuple(item[i : i + 5]) for i in range(len(item) - 4)]
            if f" {' '.join(item)} " in f" {text} ":
                assert (d, b) in got
                some += 1
            elif sum(p in fives for p in parts) < len(parts) / 3:
                assert (d, b) not in got
    assert some > 5


def test_partial_passages(spark):
    """A run of 13 words is found whatever its share of the item; shorter runs, or two of them, are not."""
    item = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(400)]
    other = "nothing of this is known to anyone".split()
    parts = {1: item[100:250], 2: item[50:63], 3: item[50:62], 4: item[10:20] + other + item[20:30], 5: item[387:], 6: item[:12] + other + item[300:312]}
    docs = [(i, " ".join(other + part + other)) for i, part in parts.items()]
    docs += [(7, OTHER + " the end"), (8, "Each morning Peter walks 45 miles to the old mill then")]
    got = search(spark, docs, [(1, " ".join(item)), (2, ITEM + " " + " ".join(item))])
    assert got == {(d, i): False for d in (1, 2, 5) for i in (1, 2)} | {(7, 2): True}
