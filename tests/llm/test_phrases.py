import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import phrases
from lodestar.llm.quotient import CountingQuotientFilter, Packing, merged

SCHEMA = "doc_id long, text string, lang string, ids int, phrase string"


def slow_collocations(docs, least, longest=5, top=2000):
    counts = {}
    for text, lang in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = {q for p, c in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if c >= f[q := p[i : i + k]]}
        rows = []
        for p, a in frequent.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(spark, docs, **options):
    df = spark.createDataFrame([(i, t, g, i, "x") for i, (t, g) in enumerate(docs)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def texts(seed, n=200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["The", "the", "of", "É", "a\xa0b", "x" * 500]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", " ! "]) for _ in range(rng.randrange(60)))
    return [(make(), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(n)] + [(None, "en"), ("", None), (" .,; ", "fr"), ("in New York City today " * 400, "en")]


@pytest.mark.parametrize("size", [None, (300, 700, 500, 50)])
def test_against_brute_force(spark, size, monkeypatch):
    for name, value in zip(("BLOCK_WORDS", "HELD_WORDS", "RANGE_WORDS", "SLICE"), size or ()):
        monkeypatch.setattr(phrases, name, value)
    docs = texts(1)
    for least, top in ((3, 2000), (20, 7)):
        want = slow_collocations(docs, least, top=top)
        assert found(spark, docs, least=least, top=top) == want and len(want) > 4


def test_ties_and_long_counts(spark):
    docs = [("a b c d e f g", "en")] * 150 + [("a b", "en")] * 50 + [("g a b a b", "en")] * 120 + [("x " * 3000, "de")]
    assert found(spark, docs) == slow_collocations(docs, 100)


def test_nothing_to_find(spark):
    assert found(spark, [("one two three", "en"), (None, None)]) == found(spark, []) == []


KEYS = st.integers(1, 40).flatmap(
    lambda bits: st.tuples(st.just(bits), st.integers(1, 6)).flatmap(
        lambda t: st.tuples(st.just(t[0]), st.lists(st.lists(st.integers(0, (1 << t[0]) - 1), min_size=t[1], max_size=t[1]), min_size=1, max_size=60))
    )
)


@settings(max_examples=200, deadline=None)
@given(KEYS, st.integers(1, 9))
def test_filter_is_lossless(keys, parts):
    bits, rows = keys
    packing = Packing(len(rows[0]), bits)
    rows = rows + rows[:7] * 300
    filter_, entry = CountingQuotientFilter.of([np.array(w, np.int64) for w in zip(*rows)], packing)
    words = list(zip(*[w.tolist() for w in filter_.words()]))
    assert Counter(map(tuple, rows)) == dict(zip(words, filter_.counts.tolist()))
    assert [words[e] for e in entry] == [tuple(r) for r in rows]
    pieces, before = [], 0
    for end in filter_.cuts(parts).tolist():
        if end > before:
            pieces.append(CountingQuotientFilter.from_bytes(filter_.to_bytes(before, end), packing))
        before = end
    both, place = merged([*pieces, filter_])
    assert both.counts.tolist() == (2 * filter_.counts).tolist() and place.tolist() == [*range(len(words))] * 2
    assert all(np.array_equal(a, b) for a, b in zip(both.lanes, filter_.lanes))
