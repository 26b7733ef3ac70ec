import random

import numpy as np
import pytest

from lodestar.llm import langid
from lodestar.llm.langid import Parser, SampleBound, identified, sample, suffix_automaton, verdicts
from lodestar.llm.queries import op8_cross_parsing

SAMPLES = (("de", "der hund und die katze sind im haus und schlafen"), ("en", "the dog and the cat are in the house and sleep"))


def substrings(symbols):
    return {tuple(symbols[a:b]) for a in range(len(symbols)) for b in range(a, len(symbols) + 1)}


@pytest.mark.parametrize("seed", range(5))
def test_automaton_spells_all_substrings(seed):
    symbols = random.Random(seed).choices(range(3), k=30)
    ways, found = suffix_automaton(symbols), set()

    def walk(state, path):
        found.add(path)
        for s, to in ways[state].items():
            walk(to, (*path, s))

    walk(0, ())
    assert found == substrings(symbols)


def slow_phrases(symbols, sample_symbols):
    """Greedy longest phrases of the whole text."""
    known, total, at = substrings(sample_symbols), 0, 0
    while at < len(symbols):
        end = at + 1
        while end < len(symbols) and tuple(symbols[at : end + 1]) in known:
            end += 1
        total, at = total + 1, end
    return total


@pytest.mark.parametrize("piece, abreast", [(langid.PIECE, langid.SIDE_BY_SIDE), (7, 3), (1, 1), (64, 5)])
def test_phrases_against_brute_force(monkeypatch, piece, abreast):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "SIDE_BY_SIDE", abreast)
    parser = Parser((*SAMPLES, ("xx", "a" * 90 + " ab")))
    texts = ["the cat sleeps", "Die KATZE schläft!!  ja", "zzz ж", "", "12 34", "the house and der hund " * 60, "a" * 700, "the dog and the cat are in " * 30]
    count, sizes = parser.phrases(texts)
    for i, text in enumerate(texts):
        symbols = parser.symbols(text).tolist()
        assert sizes[i] == (len(symbols) if any(symbols) else 0)
        for k, (_, own) in enumerate((*SAMPLES, ("xx", "a" * 90 + " ab"))):
            wanted = slow_phrases(symbols, parser.symbols(own).tolist()) if any(symbols) else 0
            assert count[i, k] == wanted


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat"), (4, "the dog and the cat"), (None, "der hund und die katze " * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = [(r["row"]["doc_id"], r["lang_pred"]) for r in identified(docs, SAMPLES).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")]
    assert {r["lang_pred"] for r in identified(docs, ()).collect()} == {"und"}
    assert identified(docs.limit(0), SAMPLES).count() == 0
    assert verdicts(["x y"], SAMPLES[:1])[0][:2] == ("de", 1.0)
    assert all(0 <= score <= 1 for _, score, _ in verdicts(["a", "b c", "the der", "ж"], SAMPLES))


def test_sample_is_bounded(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else None) for i in range(500)] + [(1000, "x" * 50, "de"), (1001, "123", "fr"), (1002, None, "it")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = dict(sample(labelled, SampleBound(rows=10, row_chars=40, chars=60)))
    assert set(got) == {"en"} and len(got["en"]) == 60
    assert sample(labelled.limit(0)) == ()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op8_cross_parsing(spark, folder).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"] and truth[r["doc_id"]]["n_chars"] >= 60]
    right = np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held])
    assert len(held) > 200 and right >= 0.97, right


@pytest.mark.parametrize("entries", [Parser.ENTRIES, 1])
def test_alphabets_of_any_size(monkeypatch, entries):
    """Letters beyond the first 250 are letters of their sample, and automata held by hash find the same phrases."""
    monkeypatch.setattr(Parser, "ENTRIES", entries)
    rng = random.Random(1)
    one, other = ("".join(chr(rng.randrange(a, a + 300)) for _ in range(250)) for a in (0x4E00, 0x5E00))
    samples = (*SAMPLES, ("ja", other), ("zh", one))
    parser = Parser(samples)
    texts = [one[50:200], other[:40] + "ж" + one[7:30], "the cat sleeps", one[:90] * 5]
    count, _ = parser.phrases(texts)
    for i, text in enumerate(texts):
        for k, (_, own) in enumerate(samples):
            assert count[i, k] == slow_phrases(parser.symbols(text).tolist(), parser.symbols(own).tolist())
    assert [v[0] for v in verdicts([one[50:200], other[50:200]], samples)] == ["zh", "ja"]
    assert verdicts([one[50:200]], samples)[0][2] < 0.02


def test_every_language_and_long_rows_are_learnt(spark):
    rows = [(i, f"text of {i}", f"l{i}") for i in range(70)] + [(100, "x y " * 10_000, "long")]
    got = dict(sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert len(got) == 71 and len(got["long"]) == 2000
